"""Logistic lines that each leave some rows out, a group or a fold, fitted side by side by Newton's method."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and lines that meet in one matrix product.
ROWS, LINES = 2048, 512
NUMBERS = pa.list_(pa.float64())
STATE = "key bigint, model int, fold double, own array<double>, times bigint, scale array<double>, free array<boolean>, b array<double>, back array<double>, loss double, open boolean"
KINDS = pa.schema([("key", pa.int64()), ("model", pa.int32()), ("fold", pa.float64()), ("own", NUMBERS), ("times", pa.int64()), ("scale", NUMBERS), ("free", pa.list_(pa.bool_())), ("b", NUMBERS), ("back", NUMBERS), ("loss", pa.float64()), ("open", pa.bool_())])


def line_sums(rows: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """1 + k + k * k numbers a line: loss, gradient and curvature of lines [fold, b] over the rows [weight, label, fold, x] of other folds."""
    w, y, x, b = rows[:, :1] * (rows[:, 2:3] != lines[:, 0]), rows[:, 1:2], rows[:, 3:], lines[:, 1:]
    eta = x @ b.T
    p = (1 + np.tanh(eta / 2)) / 2
    outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), x.shape[1] ** 2)
    return np.column_stack([(w * (np.logaddexp(0, eta) - y * eta)).sum(0), (w * (p - y)).T @ x, (w * p * (1 - p)).T @ outer])


def _matrix(cell, width: int) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(df: DataFrame, name: str, size: int) -> DataFrame:
    """(keys, name) of rows (key, array): up to `size` of them in one, arrays end to end, dealt over all cores however small."""
    def pack(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).flatten()], NUMBERS)], names=["keys", name])

    return df.mapInArrow(pack, f"keys array<bigint>, {name} array<double>").repartition(df.sparkSession.sparkContext.defaultParallelism)


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder of checkpoints that all executors share, so later plans are short; a local session without one gets a temporary one."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(top or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _met(rows: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """(key, v): `line_sums` of each open line over all blocks of rows. A task adds up its blocks, so it sends one row a line."""
    def meet(batches):
        sums: dict = {}
        for batch in batches:
            for own, keys, b in zip(*(batch.column(c) for c in ("rows", "keys", "b")), strict=True):
                keys = tuple(keys.as_py())
                sums[keys] = sums.get(keys, 0) + line_sums(_matrix(own, k + 3), _matrix(b, k + 1))
        for keys, v in sums.items():
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(list(v), NUMBERS)], names=["key", "v"])

    packed = _packed(lines.where("open").select("key", F.concat(F.array("fold"), "b")), "b", LINES)
    parts = rows.crossJoin(packed).mapInArrow(meet, "key bigint, v array<double>")
    summed = parts.select("key", F.posexplode("v").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return summed.select("key", F.transform("v", lambda s: s["x"]).alias("v"))


def _moved(line: dict, k: int) -> dict:
    """The line after one turn: a Newton step, or half the way back if the last step raised the loss."""
    if line["v"] is None:
        return line
    b, scale, free = np.array(line["b"]), np.array(line["scale"]), np.array(line["free"])
    v = np.array(line["v"]) - line_sums(np.array(line["own"]).reshape(-1, k + 3), np.array([[line["fold"], *b]]))[0]
    loss = v[0] + (scale * b * b).sum() / 2
    if line["loss"] is not None and not loss <= line["loss"] + 1e-10 * (1 + line["loss"]):
        return line | {"b": (b + np.array(line["back"])) / 2}
    down = (v[1 : k + 1] + scale * b)[free]
    move = np.linalg.solve((v[k + 1 :].reshape(k, k) + np.diag(scale))[np.ix_(free, free)], down)
    after = b.copy()
    after[free] -= move
    return line | {"back": b, "loss": loss, "b": after, "open": bool(down @ move > 1e-20 * (1 + loss))}


def leave_out_lines(cells: DataFrame, spread: list[float], models: list[list[bool]], min_train: int = 5, turns: int = 200) -> DataFrame:
    """(model, fold, own, times, b): a line for all rows but a group's; where times is 0, for all but a fold's, or for all (fold -1).

    Cells are (grp, fold, label, x, w): x is [1, exposure, covariates of mean 0], w its rows in the group, spread the sums of the covariates' squares. A model tells
    which numbers of a line are free. The penalty is half the squared norm without the intercept. Where a group is out, covariates are standardised over the others,
    but for one that is constant there. Groups of equal cells share a line, `times` of them; own is these cells end to end, [w, label, -2, x]. No line where one label or,
    without a group, under min_train rows are left.
    All lines take their Newton steps at once: blocks of distinct rows meet blocks of lines, and a group's own rows are taken off the sums. So the work is
    distinct rows times distinct groups.
    """
    k, spark = len(models[0]), cells.sparkSession
    flat = lambda fold: F.concat(F.array("w", "label", fold), "x")
    sizes = {float(f): (n, high) for f, n, high in cells.groupBy("fold").agg(F.sum("w"), F.sum(F.col("w") * F.col("label"))).collect()}
    n, high = map(sum, zip(*sizes.values(), strict=True))

    def fresh(times, fold, own, scale):
        return [{"key": 0, "model": i, "fold": fold, "own": own, "times": times, "scale": scale, "free": free, "b": [0.0] * k, "back": None, "loss": None, "open": True} for i, free in enumerate(models)]

    def begin(batches):
        for batch in batches:
            out = []
            for cell, times in zip(batch.column("own"), batch.column("times").to_pylist(), strict=True):
                own = _matrix(cell, k + 3)
                w, z = own[:, 0], own[:, 5:]
                rest, label = n - w.sum(), high - w @ own[:, 1]
                if 0 < label < rest and rest >= min_train:
                    var = (np.array(spread) - w @ z**2) / rest - (w @ z / rest) ** 2
                    out += fresh(times, -1.0, own.ravel(), [0.0, 1.0, *np.where(var > 1e-12, var, 1.0)])
            yield pa.RecordBatch.from_pylist(out, schema=KINDS)

    def step(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_moved(line, k) for line in batch.to_pylist()], schema=KINDS)

    groups = cells.groupBy("grp").agg(F.flatten(F.array_sort(F.collect_list(flat(F.lit(-2.0))))).alias("own")).groupBy("own").agg(F.count("*").alias("times"))
    few = [line for f, (m, h) in ({-1.0: (0.0, 0.0)} | sizes).items() if 0 < high - h < n - m for line in fresh(0, f, [], [0.0, *[1.0] * (k - 1)])]
    whole = spark.createDataFrame([tuple(line.values()) for line in few], STATE)
    lines = settled(groups.mapInArrow(begin, STATE).unionByName(whole).withColumn("key", F.monotonically_increasing_id()))
    rows = _packed(cells.groupBy("label", "fold", "x").agg(F.sum("w").alias("w")).select(F.lit(0).cast("bigint"), flat(F.col("fold").cast("double"))), "rows", ROWS).drop("keys").persist()
    rows.count()  # so that the join knows how small they are
    for _ in range(turns):
        if lines.where("open").isEmpty():
            rows.unpersist()
            return lines.select("model", "fold", "own", "times", "b")
        lines = settled(lines.join(_met(rows, lines, k), "key", "left").repartition(spark.sparkContext.defaultParallelism).mapInArrow(step, STATE))
    raise RuntimeError(f"logistic lines are still moving after {turns} turns")


def left_out_scores(lines: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(out, model, label, score, weight): the log odds of each row by the line that leaves its group or its fold out.

    To 9 places, as sums depend on their order and equal rows are to tie.
    """
    def score(batches):
        for batch in batches:
            for model, cell, times, b in zip(*(batch.column(c) for c in ("model", "own", "times", "b")), strict=True):
                own = _matrix(cell, k + 3)
                yield pa.record_batch([pa.array([model.as_py()] * len(own), pa.int32()), pa.array(own[:, 1]), pa.array(own[:, 3:] @ b.values.to_numpy()), pa.array(own[:, 0] * times.as_py())], names=["model", "label", "score", "weight"])

    by_group = lines.where("times > 0").mapInArrow(score, "model int, label double, score double, weight double").select(F.lit("group").alias("out"), "*")
    dot = F.aggregate(F.zip_with("x", "b", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    own = cells.groupBy("label", "fold", "x").agg(F.sum("w").alias("weight"))
    by_fold = own.join(F.broadcast(lines.where("times = 0 and fold >= 0").select("model", "fold", "b")), "fold").select(F.lit("fold").alias("out"), "model", "label", dot.alias("score"), "weight")
    return by_group.unionByName(by_fold).withColumn("score", F.round("score", 9) + 0.0)
