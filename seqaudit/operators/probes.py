"""Linear probes from moments: one pass over the rows for all folds and penalties, one pass to score."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import draw
from .rows import finite_rows
from .statistics import auroc, spearman

#: Penalties of the leave-one-out choice, and those of the choice over folds.
LOO_ALPHAS = tuple(10.0 ** (k / 2) for k in range(-6, 7))
ALPHAS = tuple(10.0**k for k in range(-3, 4))


def _matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix, from its flat values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def moment_table(df: DataFrame, features: str, y: str, key: str, held: int = 500) -> DataFrame:
    """(key, m): the Gram matrix of [1, x, y] of each key, row by row in one array.

    Tasks sum their rows in numpy and send one matrix a key, at most `held` keys at a time; Spark sums these.
    """
    def partial(batches):
        sums: dict = {}

        def out():
            flat = [m.ravel().tolist() for m in sums.values()]
            got = pa.record_batch([pa.array(list(sums), kind), pa.array(flat, pa.list_(pa.float64()))], names=["key", "m"])
            sums.clear()
            return got

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(2).type
            z = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)])
            codes = batch.column(2).dictionary_encode()
            own = codes.indices.to_numpy()
            order = np.argsort(own, kind="stable")
            starts = np.append(np.flatnonzero(np.diff(own[order], prepend=-1)), len(own))
            for low, high in zip(starts, starts[1:], strict=False):
                name, rows = codes.dictionary[int(own[order[low]])].as_py(), z[order[low:high]]
                sums[name] = sums.get(name, 0) + rows.T @ rows
                if len(sums) >= held:
                    yield out()
        if sums:
            yield out()

    kind = df.schema[key].dataType.simpleString()
    parts = df.where(F.col(key).isNotNull()).select(features, F.col(y).cast("double").alias("y"), F.col(key).alias("key")).mapInArrow(partial, f"key {kind}, m array<double>")
    summed = parts.select("key", F.posexplode("m").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    return summed.select("key", F.transform("m", lambda v: v["x"]).alias("m"))


def _square(flat) -> np.ndarray:
    return np.array(flat).reshape(int(round(len(flat) ** 0.5)), -1)


def moments(df: DataFrame, features: str, y: str, fold: str) -> dict[int, np.ndarray]:
    """The Gram matrix of [1, x, y] for each fold. The driver gets folds times (d + 2)^2 numbers, whatever the number of rows."""
    rows = df.withColumn("_fold", F.col(fold).cast("int"))
    return {r["key"]: _square(r["m"]) for r in moment_table(rows, features, y, "_fold").collect()}


def _ridge(m: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge on standardised features, in the features' own units."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0) / n)
    spread[spread < 1e-12] = 1.0
    a = cov[:-1, :-1] / np.outer(spread, spread)
    w = np.linalg.solve(a + alpha * np.eye(len(a)), cov[:-1, -1] / spread) / spread
    return float(mean[-1] - w @ mean[:-1]), w


def _squares(m: np.ndarray, b: float, w: np.ndarray) -> float:
    """Sum of squared errors of a line on the rows behind a Gram matrix."""
    c = np.concatenate([[-b], -w, [1.0]])
    return float(c @ m @ c)


def _fold_errors(train: dict, test: dict, alphas) -> list[float]:
    """Mean over folds of the mean squared error of each penalty; folds with under five training rows or no test row are left out."""
    folds = [k for k in test if test[k][0, 0] >= 1 and train[k][0, 0] >= 5]
    return [float(np.mean([_squares(test[k], *_ridge(train[k], a)) / test[k][0, 0] for k in folds])) if folds else math.inf for a in alphas]


def pick_alpha(grams: dict[int, np.ndarray], alphas=ALPHAS) -> float:
    """The penalty of least mean error over the folds, each predicted from the others; the first on ties, the middle one without two folds."""
    if len(grams) < 2:
        return alphas[len(alphas) // 2]
    total = sum(grams.values())
    errors = _fold_errors({k: total - g for k, g in grams.items()}, grams, alphas)
    return alphas[int(np.argmin(errors))] if np.isfinite(errors).any() else alphas[len(alphas) // 2]


def nested_alpha(df: DataFrame, features: str, y: str, outer: str, group: str, k: int = 3, seed: int = 42, alphas=ALPHAS) -> DataFrame:
    """(outer, alpha, mse, picked): the error of each penalty over inner folds of whole groups, for the training rows of each outer fold.

    outer null is the choice over all rows, for a penalty locked once. One pass gathers moments by (outer, inner) cell; the
    training sums of a pair of folds come from them by subtraction. Rows with a label or feature that is not finite, or a null group, go.
    """
    kept = finite_rows(df, y, features).where(F.col(group).isNotNull() & F.col(outer).isNotNull())
    inner = (draw(seed, F.lit("inner"), F.col(group)) % k).cast("int")
    cells = moments(kept.withColumn("_cell", F.col(outer).cast("int") * k + inner), features, y, "_cell")
    out = []
    for o in [None, *sorted({c // k for c in cells})]:
        rest = {c: m for c, m in cells.items() if o is None or c // k != o}
        own = {i: sum(m for c, m in rest.items() if c % k == i) for i in {c % k for c in rest}}
        if len(own) < 2:
            continue
        total = sum(own.values())
        errors = _fold_errors({i: total - m for i, m in own.items()}, own, alphas)
        out += [(o, float(a), e, n == int(np.argmin(errors))) for n, (a, e) in enumerate(zip(alphas, errors, strict=True)) if math.isfinite(e)]
    return df.sparkSession.createDataFrame(out, "outer int, alpha double, mse double, picked boolean")


def loo_errors(df: DataFrame, features: str, y: str, fold: str, training: dict[int, np.ndarray], alphas=LOO_ALPHAS) -> dict[int, np.ndarray]:
    """Squared leave-one-out errors of each penalty, summed over the training rows of each fold (those of the others).

    A row's error without itself is its residual over 1 - h, h its part of the hat diagonal; both come from one eigen-decomposition
    of the training rows' covariance, so one pass scores all penalties and folds. The driver gets folds times penalties numbers.
    """
    parts = {}
    for k, m in training.items():
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        cov = m[1:, 1:] - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0) / n)
        spread[spread < 1e-12] = 1.0
        values, vectors = np.linalg.eigh(cov[:-1, :-1] / np.outer(spread, spread))
        inverse = 1 / (np.maximum(values, 0)[:, None] + np.array(alphas))
        parts[k] = n, mean, spread, vectors, inverse, inverse * (vectors.T @ (cov[:-1, -1] / spread))[:, None]

    def sums(batches):
        total = {k: np.zeros(len(alphas)) for k in parts}
        for batch in batches:
            x, label, own = _matrix(batch.column(0)) if batch.num_rows else None, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for k, (n, mean, spread, vectors, inverse, weights) in parts.items():
                rows = own != k
                if rows.any():
                    z = ((x[rows] - mean[:-1]) / spread) @ vectors
                    off = (label[rows] - mean[-1])[:, None] - z @ weights
                    total[k] += ((off / (1 - 1 / n - z**2 @ inverse)) ** 2).sum(axis=0)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["fold", "e"])

    got = df.select(features, F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")).mapInArrow(sums, "fold int, e array<double>")
    summed = got.groupBy("fold").agg(*[F.sum(F.col("e")[i]).alias(f"e{i}") for i in range(len(alphas))])
    return {r["fold"]: np.array(r[1:]) for r in summed.collect()}


def fitted(m: np.ndarray, alpha: float) -> tuple[float, list[float]]:
    """Intercept and weights of a ridge from the Gram matrix of its training rows."""
    b, w = _ridge(m, alpha)
    return b, w.tolist()


def scored(df: DataFrame, features: str, fold: str, lines: list[tuple]) -> DataFrame:
    """df with pred, by the line (fold, intercept, weights) of each row's fold; null without one."""
    table = F.broadcast(df.sparkSession.createDataFrame(lines, "_k int, _b double, _w array<double>"))
    dot = F.aggregate(F.zip_with(features, "_w", lambda x, w: x.cast("double") * w), F.col("_b"), lambda s, x: s + x)
    got = df.join(table, F.col(fold).cast("int") == F.col("_k"), "left")
    return got.withColumn("pred", F.when(F.col("_b").isNotNull(), dot)).drop("_k", "_b", "_w")


def oof_ridge(df: DataFrame, id_col: str, features: str, y: str, fold: str, alphas=LOO_ALPHAS) -> DataFrame:
    """(id, fold, y, pred): each fold predicted from the others, the penalty chosen by leaving one of their rows out at a time.

    Rows with a label or feature that is not finite go. A fold with nothing to train on gets a null pred; of penalties with equal errors the first is taken.
    """
    kept = finite_rows(df, y, features).where(F.col(fold).isNotNull())
    grams = moments(kept, features, y, fold)
    total = sum(grams.values()) if grams else None
    training = {k: total - g for k, g in grams.items() if total[0, 0] - g[0, 0] >= 1}
    errors = loo_errors(kept, features, y, fold, training, alphas) if training else {}
    lines = [(k, *fitted(m, alphas[int(np.nanargmin(errors[k])) if np.isfinite(errors[k]).any() else len(alphas) // 2])) for k, m in training.items()]
    return scored(kept, features, fold, lines).select(F.col(id_col), F.col(fold).alias("fold"), F.col(y).alias("y"), "pred")


def probe_gap(df: DataFrame, id_col: str, features: str, y: str, random: str, blocked: str) -> DataFrame:
    """One row: rank correlation of out-of-fold predictions under random and under blocked folds, AUROC where the label is binary, and the gaps.

    delta is the gap of the primary metric, AUROC for a binary label, else the correlation.
    """
    def score(fold, name):
        pred = oof_ridge(df, id_col, features, y, fold).withColumn("all", F.lit(1))
        rho = spearman(pred, "y", "pred", ["all"]).select("all", "n", F.col("rho").alias(f"rho_{name}"))
        area = auroc(pred.where("y in (0, 1)"), "y", "pred", ["all"]).withColumnRenamed("auroc", "_auc")
        kinds = pred.agg(F.count_distinct("y").alias("_kinds"), F.count_if(~F.col("y").isin(0, 1)).alias("_else"))
        return rho.join(area, "all", "left").join(F.broadcast(kinds), F.lit(True)).select("all", "n", f"rho_{name}", F.when((F.col("_kinds") == 2) & (F.col("_else") == 0), F.col("_auc")).alias(f"auroc_{name}"))

    both = score(random, "random").join(score(blocked, "blocked").drop("n"), "all")
    gap = F.col("rho_random") - F.col("rho_blocked")
    return both.select("n", "rho_random", "rho_blocked", gap.alias("gap"), "auroc_random", "auroc_blocked", F.coalesce(F.col("auroc_random") - F.col("auroc_blocked"), gap).alias("delta"))
