"""Every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from seqaudit.operators import probes, statistics
from seqaudit.plans import audits, controls, files  # noqa: F401
from seqaudit.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "events", "part", "orders", "lineitem", "customer"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), sql.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    order = sorted(c for c in got.columns)
    keys = sorted(order, key=lambda c: (got[c].dtype.kind == "f", c))
    a, b = (x[order].sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in order:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert (pd.to_numeric(a[c]) - pd.to_numeric(b[c])).abs().max(skipna=True) in (0, pytest.approx(0, abs=2e-6)) or a[c].isna().all(), c
            assert (a[c].isna() == b[c].isna()).all(), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


def test_published_tables(spark):
    tables = spark.createDataFrame([("x", 8, 2, 2, 18), ("y", 10, 0, 10, 10)], "cls string, a bigint, b bigint, c bigint, d bigint")
    got = {r["cls"]: r for r in statistics.haldane_or(statistics.fisher_or(tables, "cls")).collect()}
    assert got["x"]["odds_ratio"] == 36 and got["x"]["fisher_p"] == pytest.approx(0.00029126296, rel=1e-6) and got["x"]["haldane_or"] == pytest.approx(25.16)
    assert (got["x"]["ci_low"], got["x"]["ci_high"]) == pytest.approx((3.644384, 173.698927), rel=1e-6)
    assert got["y"]["odds_ratio"] is None and got["y"]["haldane_or"] == 21 and got["y"]["fisher_p"] == pytest.approx(0.010993737, rel=1e-6)
    p = spark.createDataFrame([("a", 0.010993737), ("b", 1.0), ("c", 0.010993737)], "k string, p double")
    assert [r["q"] for r in statistics.bh_fdr(p, "p", "k").orderBy("k").collect()] == pytest.approx([0.016490606, 1, 0.016490606], rel=1e-6)


def test_probe_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=60)
    rows = [(i, x[i].tolist(), float(y[i]), i % 4) for i in range(60)] + [(60, [1.0, float("nan"), 0.0], 1.0, 0)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y double, fold int")
    got = {r["id"]: r["pred"] for r in probes.oof_ridge(df, "id", "x", "y", "fold", alphas=(2.0,)).collect()}
    assert len(got) == 60
    for k in range(4):
        train, test = np.arange(60) % 4 != k, np.flatnonzero(np.arange(60) % 4 == k)
        m, s = x[train].mean(0), x[train].std(0)
        z = (x[train] - m) / s
        w = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y[train] - y[train].mean()))
        assert [got[i] for i in test] == pytest.approx(list((x[test] - m) / s @ w + y[train].mean()))
