"""Findings of round 3: queries against their SQL on small tables made for the case, and operators against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqaudit.functions import columns, keyed
from seqaudit.operators import controls, draws, nulls, reports, rows, splits
from seqaudit.plans import audits, files  # noqa: F401
from seqaudit.plans import controls as control_queries  # noqa: F401
from seqaudit.plans.registry import ORACLES, QUERIES
from seqaudit.sources import files as stored


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL on given tables, each SQL text."""
    con = duckdb.connect()
    for t, text in tables.items():
        con.execute(f"copy ({text}) to '{folder}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLES[name]).df()[got.columns]
    return sorted(map(tuple, got.toPandas().values.tolist())), sorted(map(tuple, want.values.tolist()))


def events(lengths):
    """Events of users with so many rows each, values from a hash."""
    rows = " union all ".join(f"select {u} as user_id, unnest(range({n})) as i" for u, n in lengths.items())
    return f"select cast(user_id * 1000 + i as bigint) as event_id, cast(user_id as bigint) as user_id, timestamp '2020-01-01' + interval 1 minute * i as ts, 'view' as event_type, round((hash(user_id * 1000 + i) % 1000) / 7.0, 2)::double as value from ({rows}) x"


def test_wilcoxon_names_the_orders_of_its_sql(spark, tmp_path):  # F8
    lines = "select cast(o as bigint) as l_orderkey, cast(1 + (hash(o * 100 + i) % 50) as decimal(15, 2)) as l_quantity from (select o, unnest(range(o)) as i from range(3, 21) r(o)) x"
    got, want = both(spark, tmp_path, "wilcoxon", lineitem=lines)
    assert got == want and max(r[1] for r in got) == 16


def test_locus_takes_a_decimal_part(spark, tmp_path):  # F9
    got, want = both(spark, tmp_path, "resolve_locus", events=events({2: 90, 5: 50, 8: 180, 3: 60, 4: 70}))
    assert got == want and math.floor(90 * 0.7) == 62 and any(r[2] == 63 for r in got)


def test_halves_are_rounded_as_in_sql(spark):  # F10
    values = [0.0644375, 0.0626875, 0.0651875, 0.5, -0.0644375, 0.1234565, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(columns.half_up(F.col("x"))).collect()]
    assert got == [None if v is None else duckdb.sql(f"select round({v!r}::double, 6)").fetchall()[0][0] for v in values]
    assert got[0] == 0.064437


def head(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def test_draws_of_a_grid_are_single_draws(spark):  # F4 to F7
    inner, keys = [str(i) for i in (1, 9, 10, 123, 2000)], ["|7", "|accession.12", "", "|" + "long" * 20, "|ß"]
    got = keyed.draw_grid(["42|", "42|", "42|shift|3|", "42|", "42|"], inner, keys, at_once=3)
    assert got.tolist() == [[head(f"{a}{i}{b}") for i in inner] for a, b in zip(["42|", "42|", "42|shift|3|", "42|", "42|"], keys, strict=True)]
    assert spark.range(1).select(keyed.draw(42, F.lit(123), F.lit("x"))).first()[0] == keyed.draw_grid(["42|"], ["123"], ["|x"])[0, 0]


def test_draws_are_no_rows(spark):  # F4 to F7: what Spark joins and sorts does not grow with the draws
    track = spark.createDataFrame([(g, p, float(p % 5)) for g in ("a", "b") for p in range(40)], "accession string, pos int, attr double")
    spans = spark.createDataFrame([("a", "x", 3, 12), ("b", "y", 30, 40)], "accession string, cls string, s0 int, s1 int")
    top = controls.shift_top_null(track, spans, 0.1, 50)
    rows = {r["accession"]: r for r in top.collect()}
    for g, s0, s1 in (("a", 3, 12), ("b", 30, 40)):
        tops = sorted(range(40), key=lambda p: (-(p % 5), p))[:4]
        share = lambda m: sum(s0 <= (p + m) % 40 < s1 for p in tops) / 4  # noqa: B023, E731
        null = [share(head(42, i, g) % 40) for i in range(1, 51)]
        assert rows[g]["observed"] == share(0) and rows[g]["null_mean"] == pytest.approx(np.mean(null), abs=1e-6) and rows[g]["p"] == (1 + sum(x >= share(0) for x in null)) / 51
    parts = [(g, i, 5 * i) for g in ("a", "b") for i in range(3)]
    placed = nulls.placement_null(spark.createDataFrame(parts, "accession string, frag_id int, frag_start int"), spark.createDataFrame([("a", 40), ("b", 40)], "accession string, n int"), spans, 50, 6)
    for r in placed.collect():
        s0, s1, own = (3, 12, "a") if r["cls"] == "x" else (30, 40, "b")
        inside = lambda w: min(w + 6, s1) - max(w, s0) >= 3  # noqa: B023, E731
        null = [sum(inside(head(42, p, own, i) % 35) for i in range(3)) / 6 for p in range(1, 51)]
        assert r["observed"] == sum(inside(5 * i) for i in range(3)) / 6 and r["null_mean"] == pytest.approx(np.mean(null))
    assert "Generate" not in top._jdf.queryExecution().optimizedPlan().toString()


def test_global_permutations_are_shuffled_places(spark):  # sums in blocks of rows are those of the rows moved one by one
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, float(rng.randrange(40)), float(rng.randrange(2))) for i in range(700)], "_i int, a double, b double")
    sums = {block: {r["perm"]: r["x"] for r in draws.permuted_sums(rows, "a", "b", 70, 42, block=block).collect()} for block in (1 << 20, 256)}
    each = keyed.shuffled_place(rows.withColumn("n", F.lit(700)).withColumn("perm", F.explode(F.array(F.lit(1), F.lit(2), F.lit(70)))), "_i", "n", [42, F.col("perm")], "_j")
    want = each.join(rows.select(F.col("_i").alias("_j"), F.col("b").alias("c")), "_j").groupBy("perm").agg(F.sum(F.col("a") * F.col("c")).alias("x")).collect()
    assert len(sums[256]) == 70 and sums[256] == pytest.approx(sums[1 << 20]) and {r["perm"]: r["x"] for r in want} == pytest.approx({p: sums[256][p] for p in (1, 2, 70)})


def test_min_hashes_are_the_least_of_all_words(spark):  # F1, F3
    texts = ["ACGTTGCAAT" * 30, "A" * 7, "short", None, "wörter und ß" * 9]
    got = {r["id"]: r["m"] for r in reports.minhashes(spark.createDataFrame(list(enumerate(texts)), "id int, s string"), "id", F.col("s"), ("id", "m"), hashes=16).collect()}
    pair = lambda t: [int(hashlib.md5(t.encode()).hexdigest()[i : i + 8], 16) % reports.PRIME for i in (0, 8)]
    for i, x in enumerate(texts):
        words = [pair(x[j : j + 7]) for j in range(0, len(x) - 6, 31)] if x and len(x) >= 7 else []
        assert got.get(i) == ([min((u + h * v) % reports.PRIME for u, v in words) for h in range(1, 17)] if words else None)


def test_logistic_fits_read_counts(spark):  # a table repeated tenfold has the same score and, but for the penalty, the same line
    rows = [(i % 2, (i // 2) % 2 if i % 5 else 1 - (i // 2) % 2, i % 3, f"g{i % 11}") for i in range(220)]
    df = spark.createDataFrame(rows, "high int, inside int, middle int, grp string")
    one = {r["model"]: r for r in reports.logit_adjust(df, "high", "inside", ["middle"], "grp").collect()}
    y, x = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    b = w = 0.0
    for _ in range(5000):  # mean loss and half the squared weight over the rows
        off = 1 / (1 + np.exp(-(b + w * x))) - y
        b, w = b - off.mean(), w - ((off * x).mean() + w / len(y))
    assert one["crude"]["coefficient"] == pytest.approx(w, abs=1e-4) and set(one) == {"crude", "adjusted"}


def test_sets_of_loci_are_drawn_once_over_all_tasks(spark):  # F4
    track = spark.range(90).selectExpr("id % 3 as accession", "cast(id div 3 as int) as pos", "cast(id * 7 % 11 as double) as attr")
    got = reports.locus_set_null(track, spark.range(3).selectExpr("id as accession", "4 as s0", "9 as s1"), 5, 6)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3 and got.count() == 1  # lengths, scores, loci
    keys = spark.range(40).withColumnRenamed("id", "k")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        joined = keys.hint("merge").join(keys.selectExpr("k", "k + 1 as x"), "k")
        assert draws.dealt(joined, "k").select("x", F.spark_partition_id().alias("p")).groupBy("p").count().count() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_replicates_weigh_counts(spark):  # sums by blocks of values are those of the drawn rows, one by one; a constant side has no correlation
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(7)}", float(rng.randrange(3)), rng.randrange(23)) for _ in range(300)] + [(None, 1.0, 1), ("g1", None, 2), ("g2", 1.0, None)]
    df = spark.createDataFrame(rows, "grp string, a double, b int")
    got = splits.group_bootstrap(df, "grp", "a", "b", 12)
    assert "_copy" not in got._jdf.queryExecution().analyzed().toString() and got.count() == 12
    order = sorted({r[0] for r in rows if r[0]}, key=lambda g: (head(42, g), g))
    cells, values = {}, sorted({r[2] for r in rows[:300]})
    for g, x, y in rows[:300]:
        key = (order.index(g), int(x), values.index(y))
        cells[key] = cells.get(key, 0) + 1
    blocks = draws.resampled_ranks(spark.createDataFrame([(*k, w) for k, w in cells.items()], "g long, x long, y long, w long"), len(order), 12, 42, block=4)
    sums = {r["rep"]: (r["n"], r["xy"] / math.sqrt(r["xx"] * r["yy"])) for r in blocks.collect()}
    for r in got.collect():
        drawn = [order[head(42, r["rep"], j) % len(order)] for j in range(len(order))]
        own = [(x, y) for g in drawn for h, x, y in rows[:300] if h == g]
        rank = lambda v: np.array([np.sum(v < z) + (np.sum(v == z) + 1) / 2 for z in v])
        x, y = (rank(np.array(v)) for v in zip(*own))
        want = (len(own), pytest.approx(float(np.corrcoef(x, y)[0, 1]), abs=1e-9))
        assert (r["n"], r["rho"]) == want and sums[r["rep"]] == want
    flat = splits.group_bootstrap(df.withColumn("a", F.lit(1.0)), "grp", "a", "b", 3).collect()
    assert [r["rho"] for r in flat] == [None] * 3


def test_letters_are_no_rows(spark):  # F15, F14
    texts = [("a", "acgt-ACGTn"), ("a", "ttTT"), ("b", None), ("b", "cc"), (None, "GATTACA"), ("c", "ﬅacg")]
    got = rows.kmer_counts(spark.createDataFrame(texts, "k string, s string"), "k", "s", 3)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()[:1500]
    want = {}
    for k, s in texts:
        x = "".join(c for c in (s or "").upper() if c in "ACGT")
        for i in range(len(x) - 2):
            want[k, x[i : i + 3]] = want.get((k, x[i : i + 3]), 0) + 1
    assert {(r["k"], r["kmer"]): r["n"] for r in got.collect()} == want


def test_baselines_keep_their_columns_once(spark):  # F14
    df = spark.range(60).selectExpr("id", "array(id % 7 + 0D, id % 5 + 0D) as f", "(id % 7) * 2D + id % 3 as y", "cast(id % 4 as int) as r", "cast(id % 3 as int) as s")
    got = reports.baseline_matrix(df, "id", {"f": "f"}, ["y"], {"random": "r", "blocked": "s"})
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    for r in got.collect():
        pred = reports.oof_ridge(df, "id", "f", "y", {"random": "r", "blocked": "s"}[r["scheme"]]).selectExpr("1 as k", "y", "pred")
        want = reports.statistics.spearman(pred, "y", "pred", ["k"]).first()
        assert (r["n"], r["rho"]) == (want["n"], pytest.approx(want["rho"])) and r["n"] == 60


def test_a_file_a_key_takes_the_driver_no_call_a_file(spark, tmp_path, monkeypatch):  # F13
    client = spark.sparkContext._gateway._gateway_client
    sent, calls = client.send_command, []
    monkeypatch.setattr(client, "send_command", lambda *a, **k: (calls.append(1), sent(*a, **k))[1])
    took = []
    for n in (20, 200):
        calls.clear()
        stored.write_by_key(spark.range(2 * n).selectExpr("concat('g', id % {}) as k".format(n), "id as genomic_pos", "-id / 2 as attr_score"), str(tmp_path / f"{n}"), "k")
        took.append(len(calls))
    assert took[1] < took[0] + 60
    assert len(list((tmp_path / "200").glob("*.csv"))) == 200 and (tmp_path / "200" / "g7.csv").read_text() in ("genomic_pos,attr_score\n7,-3.5\n207,-103.5\n", "genomic_pos,attr_score\n207,-103.5\n7,-3.5\n")
    got = stored.scan_tracks(spark, str(tmp_path / "200" / "*.csv"))
    assert sorted(map(tuple, got.collect())) == sorted((f"g{i % 200}", i, i / 2) for i in range(400))


def test_files_by_key_hold_what_the_csv_writer_writes(spark, tmp_path):
    rows = [(None, 'a "b", c', 1.5), ("", "", None), ("x=1%", None, 1e-9), ("y", " z\nw ", float("nan")), ("y", "e\\", -0.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").coalesce(1)
    stored.write_by_key(df, str(tmp_path / "a"), "k")
    df.write.partitionBy("k").option("header", True).csv(str(tmp_path / "b"))
    theirs = {p.parent.name[2:] + ".csv": p.read_text() for p in (tmp_path / "b").glob("k=*/part-*")}
    assert {p.name: sorted(p.read_text()) for p in (tmp_path / "a").glob("*.csv")} == {k: sorted(v) for k, v in theirs.items()}


def test_bootstrap_groups_may_have_any_name(spark):
    rows = [(7 * (i % 5), float(i * i % 11), float(i % 4)) for i in range(60)]
    got = []
    for g, a, b in (("grp", "a", "b"), ("g", "x", "y"), ("y", "g", "x")):
        got.append(sorted(map(tuple, splits.group_bootstrap(spark.createDataFrame(rows, f"{g} long, {a} double, {b} double"), g, a, b, 6).collect())))
    assert got[0] == got[1] == got[2] and {n for _, n, _ in got[0]} != {0} and all(r is not None for _, _, r in got[0])
