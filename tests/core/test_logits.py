"""Logistic lines that leave one group out: against the published windows and against one fit a group in numpy."""

import numpy as np
import pytest

from seqaudit.operators import logits, reports

#: Windows of the eleven published genomes, a line each: is_high, is_polymerase_like, gc, cpg, cpa, length.
WINDOWS = """
1 0 0.4427165 0.0307117 0.0655576 10160; 0 1 0.4256324 0.0287458 0.0648750 10160; 0 0 0.4273201 0.0289370 0.0746063 10161
1 0 0.4053085 0.0201906 0.0618018 9758; 0 0 0.4013731 0.0220332 0.0715311 9759; 0 1 0.4068040 0.0203935 0.0687641 9759
1 0 0.4330361 0.0279962 0.0491850 10431; 0 0 0.4044675 0.0249281 0.0546500 10431; 0 0 0.4166028 0.0237753 0.0594382 10432
1 0 0.4334196 0.0279962 0.0494727 10431; 0 0 0.4049468 0.0250240 0.0545542 10431; 0 0 0.4167945 0.0237753 0.0593423 10432
1 0 0.3885758 0.0194475 0.0488398 9051; 0 0 0.3939461 0.0197768 0.0559054 9052; 0 0 0.4002430 0.0224285 0.0583361 9052
1 0 0.4196870 0.0275976 0.0607558 9712; 0 0 0.4078880 0.0237899 0.0566426 9711; 0 0 0.4335290 0.0288363 0.0524202 9711
1 0 0.4136449 0.0256787 0.0549209 9545; 0 0 0.3964162 0.0254664 0.0536575 9546; 0 0 0.4017399 0.0209644 0.0607966 9546
1 0 0.3758183 0.0190457 0.0532685 10082; 0 0 0.3802440 0.0167625 0.0579250 10083; 0 0 0.3779629 0.0180520 0.0580242 10083
1 0 0.3217502 0.0101605 0.0430666 8662; 0 1 0.3164762 0.0098152 0.0374134 8661; 0 0 0.3229419 0.0085450 0.0387991 8661
1 0 0.3750504 0.0145234 0.0637418 9916; 0 0 0.3823737 0.0171440 0.0735175 9917; 0 1 0.3793868 0.0125063 0.0714070 9916
1 0 0.3853288 0.0188679 0.0588173 9488; 0 0 0.3826536 0.0177066 0.0612352 9489; 0 0 0.3857911 0.0197133 0.0677841 9489
"""


def fitted(x, y, penalty):
    """Intercept and weights by Newton's method, from rows one by one."""
    x, penalty = np.column_stack([np.ones(len(x)), x]), np.diag([0.0, *penalty])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ b)
    return b


def left_out_auroc(y, e, z, groups, min_train=5):
    """AUROC of rows scored by the line of all other groups, with z standardised over these; e is None for z alone."""
    score = np.full(len(y), np.nan)
    for g in set(groups):
        out = groups == g
        if (~out).sum() < min_train or len(set(y[~out])) < 2:
            continue
        sd = z[~out].std(0)
        own = (z - z[~out].mean(0)) / np.where(sd > 1e-9, sd, 1.0)
        x = own if e is None else np.column_stack([e, own])
        b = fitted(x[~out], y[~out], np.ones(x.shape[1]))
        score[out] = np.round(b[0] + x[out] @ b[1:], 9)
    high, low = (score[(y == v) & ~np.isnan(score)] for v in (1, 0))
    return np.mean((high[:, None] > low) + (high[:, None] == low) / 2)


def test_published_windows(spark):  # the published AUROC leaves one genome out, five folds of genomes give another
    rows = [(f"g{i}", *map(float, w.split())) for i, line in enumerate(WINDOWS.strip().splitlines()) for w in line.split(";")]
    pol = np.array([r[2] for r in rows])
    rows = [(*r, float(e)) for r, e in zip(rows, (pol - pol.mean()) / pol.std(), strict=True)]
    df = spark.createDataFrame(rows, "g string, high double, pol double, gc double, cpg double, cpa double, len double, pol_z double")
    got = {r["model"]: r for r in reports.logit_adjust(df, "high", "pol_z", ["gc", "cpg", "cpa", "len"], "g").collect()}
    assert got["adjusted"]["covariates_logo_auroc"] == pytest.approx(0.5991735537190083, abs=1e-12) and got["crude"]["covariates_logo_auroc"] is None
    assert [got[m]["coefficient"] for m in ("crude", "adjusted")] == pytest.approx([-0.728922575442649, -0.68254097851292], abs=1e-5)
    y, z = np.array([r[1] for r in rows]), np.array([r[3:7] for r in rows])
    groups = np.array([r[0] for r in rows])
    assert got["adjusted"]["logo_auroc"] == pytest.approx(left_out_auroc(y, np.array([r[7] for r in rows]), z, groups), abs=1e-12)
    assert got["crude"]["logo_auroc"] == pytest.approx(left_out_auroc(y, np.array([r[7] for r in rows]), z[:, :0], groups), abs=1e-12)


def test_every_group_is_left_out_once(spark, monkeypatch):  # groups of one row and of most rows, groups alike, a covariate that only one group moves, blocks of a few rows
    monkeypatch.setattr(logits, "ROWS", 7)
    monkeypatch.setattr(logits, "LINES", 3)
    rng = np.random.default_rng(4)
    groups = np.array([0] * 90 + [1] + [2] * 12 + [3 + i // 4 for i in range(40)] + [20 + i // 3 for i in range(18)])
    e, z = rng.integers(0, 2, len(groups)).astype(float), np.column_stack([rng.integers(0, 5, len(groups)) * 250.0 + 1e6, rng.normal(size=len(groups)), groups == 2])
    y = (rng.random(len(groups)) < 1 / (1 + np.exp(-(e + z[:, 1] - 0.4)))).astype(float)
    for a in (y, e, *z.T):
        a[-18:] = np.tile(a[-3:], 6)  # six groups of the same rows
    rows = [(f"g{g}", bool(a), bool(b), *map(float, c)) for g, a, b, c in zip(groups, y, e, z, strict=True)]
    odd = [(None, True, True, 0.0, 0.0, 0.0), ("g3", None, True, 0.0, 0.0, 0.0), ("g3", True, None, 0.0, 0.0, 0.0), ("g4", True, True, float("nan"), 0.0, 0.0), ("g4", True, True, 0.0, float("inf"), 0.0)]
    df = spark.createDataFrame(rows + odd, "label string, w boolean, e boolean, grp double, c0 double, at double")
    got = {r["model"]: r for r in reports.logit_adjust(df, "w", "e", ["grp", "c0", "at"], "label").collect()}
    want = {"crude": left_out_auroc(y, e, z[:, :0], groups), "adjusted": left_out_auroc(y, e, z, groups)}
    assert {m: r["logo_auroc"] for m, r in got.items()} == pytest.approx(want, abs=1e-12)
    assert got["adjusted"]["covariates_logo_auroc"] == pytest.approx(left_out_auroc(y, None, z, groups), abs=1e-12)
    whole = fitted(np.column_stack([e, (z - z.mean(0)) / z.std(0)]), y, np.ones(4))
    assert got["adjusted"]["coefficient"] == pytest.approx(whole[1], abs=1e-9) and got["adjusted"]["odds_ratio"] == pytest.approx(np.exp(whole[1]))


def test_groups_without_the_others(spark):
    """No line where the others are under five rows or have one label; no figure where nothing is scored; no row without both labels."""
    kind = "y int, e int, x double, g string"
    one = spark.createDataFrame([(i % 2, i % 3 % 2, float(i), "a") for i in range(12)], kind)
    assert [(r["model"], r["logo_auroc"], r["covariates_logo_auroc"]) for r in reports.logit_adjust(one, "y", "e", ["x"], "g").collect()] == [("crude", None, None), ("adjusted", None, None)]
    assert reports.logit_adjust(one.where("y = 1"), "y", "e", ["x"], "g").count() == reports.logit_adjust(one.where("y > 1"), "y", "e", ["x"], "g").count() == 0
    rows = [(i % 2, i % 3 % 2, float(i * 7 % 5), "big") for i in range(30)] + [(1, 0, 1.0, "small"), (0, 1, 2.0, "small"), (1, 1, 0.0, "small")]
    got = reports.logit_adjust(spark.createDataFrame(rows, kind), "y", "e", [], "g").collect()
    assert [(r["model"], r["logo_auroc"]) for r in got] == [("crude", None), ("adjusted", None)]  # only three rows are scored, of a group whose others are 30
    more = rows + [(i % 2, 1 - i % 2, float(i), "small") for i in range(9)]
    y, e = (np.array([r[i] for r in more], float) for i in (0, 1))
    got = {r["model"]: r["logo_auroc"] for r in reports.logit_adjust(spark.createDataFrame(more, kind), "y", "e", [], "g").collect()}
    assert got == pytest.approx(dict.fromkeys(("crude", "adjusted"), left_out_auroc(y, e, np.zeros((len(y), 0)), np.array([r[3] for r in more]))), abs=1e-12)


def test_far_apart_labels_end(spark):
    """Labels that a covariate tells apart, in strongly unequal numbers, and one far value: every line settles."""
    rows = [(int(i > 560), 0, float(i) if i < 599 else 1e9, f"g{i % 60}") for i in range(600)]
    got = {r["model"]: r for r in reports.logit_adjust(spark.createDataFrame(rows, "y int, e int, x double, g string"), "y", "e", ["x"], "g").collect()}
    assert got["crude"]["coefficient"] == 0 and got["adjusted"]["odds_ratio"] == 1 and 0 <= got["adjusted"]["logo_auroc"] <= 1
