"""Composite audits, readers and odd rows, against numpy or by hand."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqaudit.functions import tails
from seqaudit.operators import intervals, panels, probes, reports, rows, statistics, tables
from seqaudit.sources import files


@pytest.fixture(scope="module")
def grouped(spark):
    """Labels and features of 40 groups of six; the label is a group's own, and so are the features."""
    rng = np.random.default_rng(42)
    mids = rng.normal(size=(40, 20))
    y = rng.normal(size=40)
    out = [(g * 6 + i, (mids[g] + rng.normal(scale=0.05, size=20)).tolist(), float(y[g] + rng.normal(scale=0.05)), f"g{g}") for g in range(40) for i in range(6)]
    return out, spark.createDataFrame(out, "id int, x array<double>, y double, grp string")


def ranked(v):
    return pd.Series(v).rank().to_numpy()


def brute_folds(spark, df, column):
    return {r["id"]: r["f"] for r in df.select("id", column.alias("f")).collect()}


def brute_scores(data, folds, alpha, k):
    x, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    fold = np.array([folds[r[0]] for r in data])
    pred = np.full(len(y), np.nan)
    for f in range(k):
        train, test = fold != f, fold == f
        if test.any() and train.any():
            m, s = x[train].mean(0), x[train].std(0)
            z = (x[train] - m) / s
            w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y[train] - y[train].mean()))
            pred[test] = (x[test] - m) / s @ w + y[train].mean()
    return pred, y, np.corrcoef(ranked(y), ranked(pred))[0, 1]


def test_split_contrast_is_numpy_s(spark, grouped):
    data, df = grouped
    got = {r["metric"]: r for r in reports.split_contrast(df, "id", "x", "y", "grp", repeats=3, k=5, alpha=1.0).collect()}
    random, blocked = [], []
    for r in range(3):
        random.append(brute_scores(data, brute_folds(spark, df, (reports.draw(F.lit(r) + 42 + 1000, F.col("id")) % 5).cast("int")), 1.0, 5)[2])
        blocked.append(brute_scores(data, brute_folds(spark, df, (reports.draw(F.lit(r) + 42, F.col("grp")) % 5).cast("int")), 1.0, 5)[2])
    assert got["random"]["mean"] == pytest.approx(np.mean(random)) and got["blocked"]["mean"] == pytest.approx(np.mean(blocked))
    assert got["delta"]["sd"] == pytest.approx(np.std(np.subtract(random, blocked), ddof=1)) and got["delta"]["n"] == 3 and got["delta"]["mean"] > 0.2
    assert reports.split_contrast(df.limit(0), "id", "x", "y", "grp", repeats=2, alpha=1.0).count() == 0


def test_logo_influence_is_numpy_s(spark, grouped):
    data, df = grouped
    few = [r for r in data if int(r[3][1:]) < 6]
    got = {r["group"]: r for r in reports.logo_influence(df.where("cast(substring(grp, 2) as int) < 6"), "id", "x", "y", "grp", alpha=1.0).collect()}
    names = sorted({r[3] for r in few})
    pred, y, full = brute_scores(few, {r[0]: names.index(r[3]) for r in few}, 1.0, 6)
    for n, g in enumerate(names):
        rest = np.array([r[3] != g for r in few])
        score = np.corrcoef(ranked(y[rest]), ranked(pred[rest]))[0, 1]
        assert (got[g]["n_test"], got[g]["status"]) == (6, "ok") and got[g]["score_without"] == pytest.approx(score) and got[g]["delta"] == pytest.approx(score - full)


def test_audit_report_tells_group_labels(spark, grouped):
    """A label that is its group's: a large gap between random and blocked folds, and random folds that share most groups."""
    _, df = grouped
    got = reports.audit_report(df, "id", "y", "grp", "grp", "x", other=df.where("id % 7 = 0")).first()
    assert got["n_rows"] == 240 and got["delta"] > 0.3 and got["shared_block_fraction"] > 0.5 and got["eta_squared"] > 0.9
    assert got["shared_ids"] == got["ids_b"] == 35 and got["warnings"] == []
    binary = df.withColumn("y", F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    got = reports.audit_report(binary, "id", "y", "grp", "grp", "x").first()
    assert got["auroc_random"] > got["auroc_blocked"] and got["delta"] == pytest.approx(got["auroc_random"] - got["auroc_blocked"])


def test_logit_adjust_is_newton(spark):
    rng = np.random.default_rng(1)
    gc, e = rng.normal(size=400), rng.integers(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.8 * e + 1.2 * gc - 0.3)))).astype(int)
    df = spark.createDataFrame([(int(a), int(b), float(c), i % 20) for i, (a, b, c) in enumerate(zip(y, e, gc))], "high int, e int, gc double, g int")
    got = {r["model"]: r for r in reports.logit_adjust(df, "high", "e", ["gc"], "g").collect()}
    for model, cols in (("crude", [e]), ("adjusted", [e, (gc - gc.mean()) / gc.std()])):
        x, w = np.stack([*cols, np.ones(400)], 1).astype(float), np.zeros(len(cols) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            own = np.append(np.ones(len(cols)), 0)
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(own), x.T @ (p - y) + own * w)
        assert got[model]["coefficient"] == pytest.approx(w[0], abs=1e-4) and got[model]["odds_ratio"] == pytest.approx(np.exp(w[0]), abs=1e-3)
    assert got["adjusted"]["auroc"] > got["crude"]["auroc"] > 0.5


def test_minhash_leakage_by_hand(spark):
    rng = np.random.default_rng(2)
    text = lambda: "".join(rng.choice(list("ACGT"), 3000))
    own = [text() for _ in range(6)]
    near = own[2][:2800] + text()[:200]
    a = spark.createDataFrame([*enumerate(own), (6, own[2]), (7, None), (8, "ACG")], "id int, seq string")
    b = spark.createDataFrame([(10, own[1]), (11, near), (12, text()), (13, None), (14, "ACG")], "id int, seq string")
    got = {r["id_b"]: r for r in reports.minhash_leakage(a, b, "id", "seq").collect()}
    sets = lambda s: {s[i : i + 7] for i in range(0, len(s) - 6, 31)}
    jaccard = len(sets(own[2]) & sets(near)) / len(sets(own[2]) | sets(near))
    assert {k: r["id_a"] for k, r in got.items()} == {10: 1, 11: 2} and got[10]["agreement"] == 1 and abs(got[11]["agreement"] - jaccard) < 0.15
    assert {r["id"] for r in reports.clean_manifest(a, b.where("id = 10"), "id", "seq").collect()} == {0, 2, 3, 4, 5, 6, 7, 8}


def test_log_gamma(spark):
    got = spark.range(1).select(*[F.expr(tails._log_factorial(f"{z}D")).alias(str(i)) for i, z in enumerate((0, 1, 2.5, 9, 1e6, 1e9))]).first()
    assert list(got) == pytest.approx([math.lgamma(z + 1) for z in (0, 1, 2.5, 9, 1e6, 1e9)], rel=1e-12, abs=1e-11)


def test_fisher_of_large_tables(spark):
    """Large counts against the normal form of the log odds ratio."""
    own = spark.createDataFrame([("x", 30, 20, 25, 40), ("y", 5_001_000, 5_000_000, 4_998_000, 5_001_500)], "k string, a bigint, b bigint, c bigint, d bigint")
    got = {r["k"]: r for r in statistics.fisher_or(own, "k").collect()}
    for k, far in (("x", 0.35), ("y", 0.002)):
        a, b, c, d = (got[k][x] + 0.5 for x in "abcd")
        z = abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        assert got[k]["fisher_p"] == pytest.approx(math.erfc(z / 2**0.5), rel=far)


def test_odd_rows(spark):
    texts = spark.createDataFrame([(1, "Risk Name: A\nWeighted Score: .\nRisk Name: B\nWeighted Score: 2.5\nImpact Score: 1.2.3\nRisk Name: C\nWeighted Score: -4"), (2, None), (3, "")], "id int, t string")
    assert [tuple(r) for r in rows.parse_factors(texts, "id", "t").collect()] == [(1, "B", 2.5, None, None)]
    seqs = spark.createDataFrame([(1, "cacacx-CA"), (2, None), (3, "C"), (4, "")], "id int, s string")
    assert {r["id"]: r["frac"] for r in rows.dinuc_frac(seqs, "s", "CA").collect()} == pytest.approx({1: 3 / 6, 2: None, 3: None, 4: None})
    assert sorted((r["kmer"], r["n"]) for r in rows.kmer_counts(seqs, "id", "s", 3).collect()) == [("ACA", 1), ("ACC", 1), ("CAC", 2), ("CCA", 1)]
    queries = spark.createDataFrame([("g", 0, 10), ("g", 0, 10), ("g", 50, 60), ("h", 0, 5)], "accession string, w0 int, w1 int")
    spans = spark.createDataFrame([("g", "c", 2, 7), ("g", "c", 5, 9), ("g", "d", 9, 40)], "accession string, cls string, s0 int, s1 int")
    got = sorted((r["cls"], r["covered"], r["frac"]) for r in intervals.interval_overlap(queries, spans).collect())
    assert got == [("c", 7, 0.7), ("c", 7, 0.7), ("d", 1, 0.1), ("d", 1, 0.1)]
    points = spark.createDataFrame([("g", 2), ("g", 8), ("g", 9), ("g", 40), ("h", 3)], "accession string, pos int")
    assert sorted((r["pos"], r["cls"]) for r in intervals.point_in_interval(points, spans).collect()) == [(2, "c"), (8, "c"), (9, "d")]
    track = spark.createDataFrame([("g", 1, 1.0, 0), ("g", 1, -3.0, 1), ("g", 4, 2.0, 0)], "accession string, pos int, attr double, seen int")
    assert [r["attr"] for r in panels.dense_track(track, order="seen").orderBy("pos").collect()] == [0.0, -3.0, 0.0, 0.0, 2.0]
    windows = spark.createDataFrame([("g", 0, 0, 4), ("g", 1, 4, 8), ("h", 0, 0, 4)], "accession string, window_index int, w0 int, w1 int")
    assert sorted((r["window_index"], r["score"]) for r in intervals.window_scores(track, windows).collect()) == [(0, 1.0), (1, 0.5)]
    labels = spark.createDataFrame([("a", 1.0), ("a", None), ("a", None), (None, 1.0)], "b string, y double")
    assert statistics.purity(labels, "y", "b").where("b = 'a'").first()["purity"] == 1.0 and statistics.icc_groups(labels, "y", "b").first()[0] is None
    copies = spark.createDataFrame([(1, "t"), (2, "t"), (3, None)], "id int, t string")
    assert [tuple(r)[1:] for r in statistics.content_overlap(copies, copies, "id", "t").collect()] == [(1, 1, 2, 2)]
    with pytest.raises(ValueError):
        tables.assemble_features(copies, id_col="id", external=copies.withColumn("features", F.array(F.lit(1.0))).limit(2))
    assert [r["first"] for r in tables.capped_sample(copies.unionByName(copies), "t", "id", 1).collect() if r["t"]] == [[1]]


def test_odd_files(spark, tmp_path):
    flat = tmp_path / "AC_7.gb"
    flat.write_text('LOCUS  \nFEATURES             Location/Qualifiers\n     gene            complement(join(5..9,\n                     <20..>31))\n                     /gene="Spike"\n                     /note="x"\n     CDS             7\n     misc            1..4\n     mat_peptide     order(3..2,12..14)\n                     /product="RNA pol\n                     ymerase"\n                     /gene="g"\nORIGIN\n     6001 acgt\n//\n')
    got = sorted((r["accession"], r["ftype"], r["s0"], r["s1"], r["label"], r["gene"]) for r in files.scan_annotations(spark, str(flat)).collect())
    assert got == [("AC_7", "gene", 4, 9, "spike", "spike"), ("AC_7", "gene", 19, 31, "spike", "spike"), ("AC_7", "mat_peptide", 11, 14, "rna pol", "g")]
    (tmp_path / "x.1_attr.csv").write_text("genomic_pos,attr_score\n0,-1.5\n1,junk\n,3\nz,4\n")
    (tmp_path / "empty_attr.csv").write_text("genomic_pos,attr_score\n")
    assert sorted(((r["accession"], r["pos"], r["attr"]) for r in files.scan_tracks(spark, str(tmp_path / "*_attr.csv")).collect())) == [("x", 0, 1.5), ("x", 1, None)]
    (tmp_path / "s.fasta").write_text(">NC_1.2 Virus|whole\nac gt\nAC\n\n>lineage|12nt|OM99 iso\n>only header words\nTT\n")
    assert sorted((r["accession"], r["sequence"]) for r in files.scan_sequences(spark, str(tmp_path / "s.fasta")).collect()) == [("NC_1.2", "ACGTAC"), ("OM99", ""), ("only", "TT")]


def test_files_query_names():
    from seqaudit.plans import audits, controls, registry  # noqa: F401
    from seqaudit.plans import files as plans

    assert plans and {"scan_annotations", "hash_manifest", "known_locus_scores", "locus_set_null"} <= {*registry.ORACLES} and duckdb and probes
