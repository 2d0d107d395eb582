"""Controls that SQL cannot check, and edge cases."""

import numpy as np
import pytest

from seqaudit.operators import controls


def test_f_tail():
    assert controls.f_tail(4.0, 1, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert controls.f_tail(0.5, 2, 8) == pytest.approx((1 + 2 * 0.5 / 8) ** -4, rel=1e-9)
    assert controls.f_tail(0.0, 3, 5) == 1


def test_partial_f_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(50, 2)), np.arange(50) % 3
    y = x @ [0.5, 0.1] + g + rng.normal(size=50)
    rows = [(int(g[i]), float(y[i]), *map(float, x[i])) for i in range(50)] + [(1, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, y double, a double, b double")
    got = controls.partial_f(df, "y", ["a", "b"], "g").first()
    dummies = np.eye(3)[g]
    rss = lambda z: float(np.sum((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2))
    low, full = rss(dummies), rss(np.column_stack([dummies, x]))
    assert (got["n"], got["df1"], got["df2"]) == (50, 2, 45)
    assert (got["rss_reduced"], got["rss_full"], got["f"]) == pytest.approx((low, full, (low - full) / 2 / (full / 45)), rel=1e-6)
    assert controls.partial_f(df.limit(0), "y", ["a"], "g").count() == 0


def test_pca_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(40, 4)) @ np.diag([5, 1, 2, 3]) + [1, 2, 3, 4]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "id int, x array<double>")
    got = np.array([r["scores"] for r in controls.pca_scores(df, "x", 2).orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][:2].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)


def test_codons(spark):
    df = spark.createDataFrame([(1, "ATGTTTAAANNN", "atgttcaga"), (2, "ATG", "ATA"), (3, None, "ATG"), (4, "ATG---TTTAAA", "ATGAAATTTAAG")], "id int, x string, y string")
    got = {r["id"]: r for r in controls.codon_counts(df, "id", "x", "y").collect()}
    assert tuple(got[1])[1:5] == (3, 1, 1, 1) and got[1]["dn"] == pytest.approx(1 / 6.75) and got[1]["ds"] == pytest.approx(1 / 2.25)
    assert got[2]["dn"] is None and got[2]["aa_diff"] == 1 and got[3]["codons"] == 0
    assert tuple(got[4])[1:5] == (3, 1, 0, 0)
