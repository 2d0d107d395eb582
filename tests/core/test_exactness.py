"""Tails, ranks, permutations, folds, probes and joins against brute force, with ties, nulls, constants and hot keys."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqaudit.functions.columns import upper_tail
from seqaudit.functions.keyed import shuffled_place
from seqaudit.functions.tails import Hypergeometric, binomial_at_least
from seqaudit.operators import controls, intervals, nulls, panels, probes, reports, splits, statistics, tables


def test_constant_columns_are_null(spark):
    rows = [(i, f"g{i % 4}", 1.0, float(i), [float(i), 1.0]) for i in range(40)] + [(99, None, None, 5.0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, g string, y double, p double, x array<double>")
    assert {r["rho"] for r in statistics.spearman(df, "y", "p", ["g"], min_n=1).collect()} == {None}
    assert {r["rho"] for r in statistics.spearman(df.where("id = 1"), "p", "p", [], min_n=1).collect()} == {None}
    assert {(r["pearson"], r["r2"]) for r in statistics.reg_metrics(df, "y", "p", ["g"]).collect()} == {(None, None)}
    got = controls.label_perm_global(df, "id", "p", "y", 5).first()
    assert (got["observed"], got["null_mean"], got["p"]) == (None, None, None)
    assert {r["rho"] for r in splits.group_bootstrap(df, "g", "y", "p", 3).collect()} == {None}
    assert tables.fidelity(df.withColumn("s", F.lit(0.5)), "y", "p", "s").first()["rho"] is None
    flat = reports.logo_influence(df, "id", "x", "y", "g").collect()
    assert len(flat) == 4 and {(r["score_without"], r["delta"]) for r in flat} == {(None, None)}
    assert reports.split_contrast(df, "id", "x", "y", "g", repeats=2).count() == 0


def test_tails_are_exact(spark):
    rng = random.Random(1)
    cases = [(n := rng.randrange(1, 60), rng.randrange(0, n + 1), rng.randrange(0, n + 1)) for _ in range(60)] + [(0, 0, 0), (5, 0, 3), (5, 5, 5), (400, 200, 200)]
    rows = [(n, r, k, x) for n, r, k in cases for x in {max(0, r + k - n), min(r, k), (max(0, r + k - n) + min(r, k)) // 2}]
    df = spark.createDataFrame(rows, "n bigint, r bigint, k bigint, x bigint")
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    up = {tuple(v[:4]): v["p"] for v in Hypergeometric(df, n, r, k).at_least(F.col("x"), "p").select("n", "r", "k", "x", "p").collect()}
    two = {tuple(v[:4]): v["p"] for v in Hypergeometric(df, n, r, k).no_likelier(F.col("x"), "p").select("n", "r", "k", "x", "p").collect()}
    for key in rows:
        n, r, k, x = key
        ways = {v: math.comb(k, v) * math.comb(n - k, r - v) for v in range(max(0, r + k - n), min(r, k) + 1)}
        total = math.comb(n, r)
        assert up[key] == pytest.approx(float(Fraction(sum(w for v, w in ways.items() if v >= x), total)), rel=1e-9, abs=1e-14)
        assert two[key] == pytest.approx(float(Fraction(sum(w for w in ways.values() if w <= ways[x] * (1 + 1e-7)), total)), rel=1e-9)
    draws = [(n, k, p) for n, p in ((1, 0.5), (7, 0.2), (40, 0.9), (300, 0.45)) for k in {0, 1, n // 2, n, n + 1}]
    got = binomial_at_least(spark.createDataFrame(draws, "n bigint, k bigint, p0 double"), F.col("n"), F.col("k"), F.col("p0"), "p").collect()
    for v in got:
        assert v["p"] == pytest.approx(sum(math.comb(v["n"], x) * v["p0"] ** x * (1 - v["p0"]) ** (v["n"] - x) for x in range(v["k"], v["n"] + 1)), rel=1e-9, abs=1e-14)
    far = spark.createDataFrame([(10_000_000, 5_004_000, 0.5), (10_000_000, 4_990_000, 0.5)], "n bigint, k bigint, p0 double")
    far = [v["p"] for v in binomial_at_least(far, F.col("n"), F.col("k"), F.col("p0"), "p").collect()]
    assert far == pytest.approx([0.5 * math.erfc((k - 0.5 - 5e6) / math.sqrt(2.5e6) / math.sqrt(2)) for k in (5_004_000, 4_990_000)], rel=1e-4)


def test_normal_tail(spark):
    zs = [-40.0, -5.0, -1.0, -1e-9, 0.0, 0.3, 1.96, 4.2, 4.25, 8.0, 20.0, 37.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(upper_tail("z")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(z / 2**0.5) for z in zs], rel=1e-9, abs=1e-300)


def test_signed_ranks_are_exact(spark):
    rng = random.Random(4)
    groups = {f"g{n}": [rng.choice([-1, 1]) * rng.randrange(1, 12) + rng.random() * (n % 2) for _ in range(n)] for n in (5, 8, 11, 30, 60)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in [*vs, 0.0]] + [("g5", None), ("few", 1.0)], "g string, v double")
    got = {r["g"]: r for r in nulls.wilcoxon(df, "g", "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        order = sorted(abs(v) for v in vs)
        ranks = [2 * order.index(abs(v)) + order.count(abs(v)) + 1 for v in vs]  # doubled
        ways = {0: 1}
        for r in ranks:
            new = dict(ways)
            for s, w in ways.items():
                new[s + r] = new.get(s + r, 0) + w
            ways = new
        w, middle = sum(r for r, v in zip(ranks, vs, strict=True) if v > 0), Fraction(sum(ranks), 2)
        p = Fraction(sum(x for s, x in ways.items() if abs(s - middle) >= abs(w - middle)), 2 ** len(vs))
        assert got[g]["w"] == w / 2 and got[g]["p"] == pytest.approx(float(p), rel=1e-9)


def test_sums_run_up_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), float(rng.randrange(300)), rng.randrange(2), rng.random()) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k string, s double, y int, w double")
    for by in ([], ["k"]):
        sums = df.groupBy(*by, "s").agg(F.sum("w").alias("w"))
        plain, cut = ({tuple(r[c] for c in (*by, "s")): r["w_under"] for r in statistics.run_up(sums, by, "s", ["w"], cut_over=n, ranges=16).collect()} for n in (10**6, 50))
        assert plain.keys() == cut.keys() and all(plain[k] == pytest.approx(cut[k], abs=1e-9) for k in plain)
        assert statistics.run_up(sums, by, "s", ["w"], cut_over=50, ranges=16).where("_b > 0").count() > 0
    area = statistics.auroc(df, "y", "s", [], "w").first()["auroc"]
    pos, neg = ([(s, w) for _, s, y, w in rows if y == v] for v in (1, 0))
    assert area == pytest.approx(sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg) / sum(a for _, a in pos) / sum(b for _, b in neg))
    steps = sorted({s for _, s, _, _ in rows}, reverse=True)
    tp = [sum(w for s, w in pos if s >= t) for t in steps]
    every = [sum(w for _, s, _, w in rows if s >= t) for t in steps]
    want = sum((x - y) * x / z for x, y, z in zip(tp, [0, *tp], every, strict=False)) / tp[-1]
    assert statistics.average_precision(df, "y", "s", [], "w").first()["avg_precision"] == pytest.approx(want)
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0.01, 0.04, 0.04, 0.03, 0.9, 0.5])] + [(9, None)], "k int, p double")
    assert [r["q"] for r in statistics.bh_fdr(p, "p", "k").orderBy("k").collect()] == pytest.approx([0.06, 0.06, 0.06, 0.06, 0.9, 0.6, None])
    many = spark.createDataFrame([(i, rng.random() ** 2) for i in range(400)], "k int, p double")
    one, cut = ([r["q"] for r in statistics.bh_fdr(many, "p", "k", cut_over=n).orderBy("k").collect()] for n in (1000, 50))
    assert one == pytest.approx(cut)


def test_places_are_shuffled_one_to_one(spark):
    sizes = [1, 2, 3, 5, 17, 100, 1023, 2000]
    rows = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n bigint, i bigint").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("perm"))
    got: dict = {}
    for r in shuffled_place(rows, "i", "n", [7, F.col("perm")], "j").collect():
        got.setdefault((r["n"], r["perm"]), {})[r["i"]] = r["j"]
    assert all(sorted(v.values()) == list(range(n)) for (n, _), v in got.items())
    assert got[2000, 1] != got[2000, 2] and abs(np.corrcoef(list(got[2000, 1]), list(got[2000, 1].values()))[0, 1]) < 0.1
    df = spark.createDataFrame([(i % 37, ["a", "b", None][i % 3], float(i)) for i in range(60)], "id int, s string, y double")
    for stratum in ("s", None):
        perms = splits.label_perm(df, "id", "y", stratum, 3)
        if stratum:  # without one, only the 4096 counts of hash_rank meet in one task
            assert "SinglePartition" not in perms._jdf.queryExecution().executedPlan().toString()
        out = perms.collect()
        assert len(out) == 180 and all(sorted(r["permuted"] for r in out if r["perm"] == b) == [float(i) for i in range(60)] for b in (1, 2, 3))
    within = splits.label_perm(df.withColumn("id", F.col("y").cast("int")), "id", "y", "s", 2).collect()
    assert all(r["id"] % 3 == r["permuted"] % 3 for r in within) and any(r["id"] != r["permuted"] for r in within)


def test_greedy_folds_are_brute_force(spark):
    rng = random.Random(9)
    for sizes in ([rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(200)], [5] * 13, [9], [100, 1, 1, 1, 1, 1, 1, 1]):
        df = spark.createDataFrame([(f"g{i}", j) for i, n in enumerate(sizes) for j in range(n)], "g string, j int")
        got = {r["g"]: (r["n"], r["fold"]) for r in panels.group_fold_greedy(df, "g", 3).collect()}
        order = [r["g"] for r in splits.hash_rank(df.select("g").distinct(), "g", 42).orderBy("_rank").collect()]
        loads = [0, 0, 0]
        for g in sorted(order, key=lambda g: -sizes[int(g[1:])]):
            f = loads.index(min(loads))
            assert got[g] == (sizes[int(g[1:])], f)
            loads[f] += sizes[int(g[1:])]


def test_residuals_are_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 120
    by, cls, x, z = rng.integers(0, 2, n), rng.integers(0, 4, n), rng.normal(size=n), rng.normal(size=n)
    y = 2 * x - z + cls + by + rng.normal(size=n)
    rows = [(i, f"b{by[i]}", f"c{cls[i]}", float(x[i]), float(z[i]), float(y[i])) for i in range(n)]
    rows += [(n, "b0", "c0", None, 1.0, 1.0), (n + 1, "b0", "c0", 1.0, float("nan"), 1.0), (n + 2, "b0", None, 1.0, 1.0, 1.0), (n + 3, "b1", "c1", 1.0, 1.0, None), (n + 4, "alone", "c1", 1.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "id int, b string, c string, x double, z double, y double")
    got = {r["id"]: r["residual"] for r in nulls.residualize(df, "y", ["x", "z"], ["b"], "c").collect()}
    assert len(got) == n + 5 and all(got[i] is None for i in range(n, n + 4)) and got[n + 4] == 0
    for v in (0, 1):
        own = np.flatnonzero(by == v)
        design = np.column_stack([x[own], z[own], *[(cls[own] == c).astype(float) for c in range(4)]])
        want = y[own] - design @ np.linalg.lstsq(design, y[own], rcond=None)[0]
        assert [got[i] for i in own] == pytest.approx(list(want), abs=1e-8)
    twice = nulls.residualize(df.where(f"id < {n}").withColumn("x2", F.col("x") * 2), "y", ["x", "x2"]).collect()
    slope, start = np.polyfit(x, y, 1)
    assert {r["id"]: r["residual"] for r in twice} == pytest.approx({i: y[i] - slope * x[i] - start for i in range(n)}, abs=1e-8)


def ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: (v - m) / s @ w + y.mean()


def test_penalties_left_out_one_at_a_time(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 4)) * [1, 5, 0.1, 2]
    y = x @ [0.5, 0.0, 4.0, 0.0] + 2 * rng.normal(size=70)
    fold, group = np.arange(70) % 5, np.arange(70) % 14
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i]), f"g{group[i]}") for i in range(70)], "id int, x array<double>, y double, fold int, g string")
    grams = probes.moments(df, "x", "y", "fold")
    total = sum(grams.values())
    got = probes.loo_errors(df, "x", "y", "fold", {k: total - g for k, g in grams.items()})
    pred = {r["id"]: r["pred"] for r in probes.oof_ridge(df, "id", "x", "y", "fold").collect()}
    for k in range(5):
        tx, ty = x[fold != k], y[fold != k]
        z, c = (tx - tx.mean(0)) / tx.std(0), ty
        errors = []
        for a in probes.LOO_ALPHAS:  # the scale stays that of the whole training set, as where a scaler is fitted before
            out = 0.0
            for i in range(len(z)):
                rest = np.arange(len(z)) != i
                mean, center = z[rest].mean(0), c[rest].mean()
                w = np.linalg.solve((z[rest] - mean).T @ (z[rest] - mean) + a * np.eye(4), (z[rest] - mean).T @ (c[rest] - center))
                out += (c[i] - center - (z[i] - mean) @ w) ** 2
            errors.append(out)
        assert list(got[k]) == pytest.approx(errors, rel=1e-6)
        line = ridge(tx, ty, probes.LOO_ALPHAS[int(np.argmin(errors))])
        assert [pred[i] for i in np.flatnonzero(fold == k)] == pytest.approx(list(line(x[fold == k])))
    nested = probes.nested_alpha(df, "x", "y", "fold", "g").collect()
    inner = {r["g"]: r["i"] for r in df.select("g", (F.conv(F.substring(F.md5(F.concat(F.lit("42|inner|"), "g")), 1, 8), 16, 10).cast("bigint") % 3).alias("i")).distinct().collect()}
    part = np.array([inner[f"g{v}"] for v in group])
    for outer in (None, 0, 3):
        keep = np.ones(70, bool) if outer is None else fold != outer
        want = {a: np.mean([np.mean((ridge(x[keep & (part != i)], y[keep & (part != i)], a)(x[keep & (part == i)]) - y[keep & (part == i)]) ** 2) for i in set(part[keep])]) for a in probes.ALPHAS}
        own = {r["alpha"]: r for r in nested if r["outer"] == outer}
        assert {a: r["mse"] for a, r in own.items()} == pytest.approx(want)
        assert [a for a, r in own.items() if r["picked"]] == [min(want, key=want.get)]


def test_influence_of_binary_labels(spark):
    rng = np.random.default_rng(8)
    n = 90
    group, x = np.arange(n) % 6, rng.normal(size=(n, 2))
    y = ((x[:, 0] + 0.5 * rng.normal(size=n)) > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), f"g{group[i]}") for i in range(n)], "id int, x array<double>, y double, g string")
    got = {r["group"]: r for r in reports.logo_influence(df, "id", "x", "y", "g", alpha=1.0).collect()}
    pred = np.zeros(n)
    for g in range(6):
        pred[group == g] = ridge(x[group != g], y[group != g], 1.0)(x[group == g])

    def area(keep):
        pos, neg = pred[keep & (y == 1)], pred[keep & (y == 0)]
        return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))

    for g in range(6):
        want = area(group != g)
        assert got[f"g{g}"]["score_without"] == pytest.approx(want) and got[f"g{g}"]["delta"] == pytest.approx(want - area(np.ones(n, bool)))


def test_bins_follow_lengths(spark):
    rng = random.Random(12)
    spot = lambda longest: (a := rng.randrange(2000), a + rng.choice([1, 2, 3, 40, longest]))
    spans = [(rng.choice("ab"), rng.choice("xyz"), *spot(1500)) for _ in range(120)] + [("a", "x", 5, 5), (None, "x", 0, 9)]
    queries = [(rng.choice("ab"), i, *spot(900)) for i in range(80)] + [("a", 99, 7, 7), ("c", 98, 0, 50)]
    s = spark.createDataFrame(spans, "accession string, cls string, s0 int, s1 int")
    q = spark.createDataFrame(queries, "accession string, i int, w0 int, w1 int")
    held = {k: {p for a, c, s0, s1 in spans if (a, c) == k for p in range(s0, s1)} for k in itertools.product("ab", "xyz")}
    want = {(i, c): len(held[a, c] & set(range(w0, w1))) for a, i, w0, w1 in queries if a in "ab" for c in "xyz"}
    assert {(r["i"], r["cls"]): r["covered"] for r in intervals.interval_overlap(q, s).collect()} == {k: v for k, v in want.items() if v}
    points = spark.createDataFrame([(a, w0) for a, _, w0, _ in queries], "accession string, pos int")
    got = sorted(tuple(r) for r in intervals.point_in_interval(points, s).collect())
    assert got == sorted((a, w0, c) for a, _, w0, _ in queries for c in "xyz" if w0 in held.get((a, c), ()))


def test_sparse_tracks_are_dense_ones(spark):
    rng = random.Random(3)
    rows = [(g, p, rng.choice([0.0, 0.0, 1.0, -2.5])) for g, n in (("a", 60), ("b", 35)) for p in range(n)]
    dense = spark.createDataFrame(rows, "accession string, pos int, attr double")
    sparse, genomes = dense.where("attr <> 0"), spark.createDataFrame([("a", 60), ("b", 35)], "accession string, n int")
    spans = spark.createDataFrame([("a", "x", 50, 60), ("a", "x", 3, 9), ("b", "x", 0, 7), ("b", "y", 20, 21)], "accession string, cls string, s0 int, s1 int")
    one, two = (sorted(map(tuple, intervals.shift_null(t, spans, 200, genomes=g).collect())) for t, g in ((dense, None), (sparse, genomes)))
    assert one == two and len(one) == 3
    loci = spark.createDataFrame([("a", 5, 25), ("b", 1, 9)], "accession string, s0 int, s1 int")
    one, two = (reports.locus_set_null(t, loci, 20, 30, genomes=g).first() for t, g in ((dense, None), (sparse, genomes)))
    assert one == two


def test_screening_of_text_ids_and_hot_bands(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(1500))
    change = lambda s, at: s[:at] + "T" * 8 + s[at + 8 :]
    a = [(f"a{i:02}", change(base, 40 * i)) for i in range(20)] + [("far", "ACGT" * 300), ("none", None)]
    b = [(f"b{i}", change(base, 40 * i + 11)) for i in range(6)] + [("copy", a[3][1]), ("short", "AC"), ("other", "".join(rng.choice("ACGT") for _ in range(900)))]
    x, y = (spark.createDataFrame(v, "id string, s string") for v in (a, b))
    plain, dealt = (sorted(map(tuple, reports.minhash_leakage(x, y, "id", "s", often=n).collect())) for n in (1000, 2))
    assert plain == dealt and {r[0] for r in plain} == {"copy", *[f"b{i}" for i in range(6)]}
    assert ("copy", "a03", 1.0) in plain and len(plain) == 7


def test_splits_fail_hard(spark):
    df = spark.createDataFrame([(i, f"g{i % 6}", 1.0 if i % 5 == 0 else 0.0 if i % 7 else None) for i in range(60)], "id int, g string, y double")
    more = splits.oversample_minority(df, "y")
    assert more.where("y is null").count() == df.where("y is null").count() and more.where("y = 1").count() > df.where("y = 1").count()
    with pytest.raises(ValueError, match="class is empty"):
        splits.oversample_minority(df.where("y = 1 or y is null"), "y")
    with pytest.raises(ValueError, match="share g g1"):
        panels.assert_disjoint(df.where("g = 'g1'"), df.where("g in ('g1', 'g2')"), ["g"])
    panels.assert_disjoint(df.where("g = 'g1'"), df.where("g = 'g2'"), ["g", "id"])
    assert splits.shared_block_fraction(df.limit(9), "id", "g").first()[0] is None and splits.shared_block_fraction(df, "id", "g").first()[0] > 0.5
    own = df.withColumn("z", F.col("id").cast("double"))
    got = panels.geometry_report(own, "id", "z", "g", "g").first()
    assert got["block_homogeneity"] == pytest.approx(got["eta_squared"]) and got["mean_purity"] != got["block_homogeneity"]
    spans = spark.createDataFrame([("spike receptor binding domain",), ("nsp12",), ("x",)], "label string")
    assert sorted((r["label"], r["cls"]) for r in panels.class_spans(spans, ("label",)).collect()) == [("nsp12", "polymerase_replicase"), ("spike receptor binding domain", "entry_interface"), ("spike receptor binding domain", "rbd")]


def test_gate_of_positions(spark):
    rows = [(f"g{i}", w, w == 0, "c", w == 0) for i in range(12) for w in range(3)] + [(f"g{i}", w, w == 0, "d", (i + w) % 2 == 0) for i in range(12) for w in range(3)]
    df = spark.createDataFrame(rows, "accession string, window_index int, is_top boolean, cls string, inside boolean")
    got = {r["cls"]: r for r in nulls.position_perm(df, 300).collect()}
    assert got["c"]["gate"] == "keep_primary" and got["c"]["p"] < 0.01 and got["c"]["null_or_high"] < math.exp(got["c"]["observed"])
    assert got["d"]["gate"] != "keep_primary"
