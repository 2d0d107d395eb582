"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled, uniform

#: Closes a whole word, so that it is told from the words that begin like it.
END = "$"
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def stems(word: str, shortest: int) -> list[str]:
    """The word and its beginnings of `shortest` letters or more, the longest first."""
    return [word + END, *(word[:n] for n in range(len(word), shortest - 1, -1))]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, discount: float = 0.75, shortest: int = 3, rare: int = 8, often: int = 40, gap: float = 1.5, sure: float = 25.0, prior: float = 8.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """Fit two models of expressions and a calibration on a bounded sample of labelled rows.

    About per_class documents of each label are taken by a hash of their id; three quarters of them
    give the counts and a quarter calibrates. An id with several labels counts as toxic if
    any is. Null labels, ids and texts teach nothing; without both labels there is no model (None).

    Expressions are words, and they share the counts of their stems: a class counts the documents that
    have the word or stem. P(x | class) is interpolated Kneser-Ney whose history is the class: the class's count,
    discounted, and as backoff the number of classes that have x at all, which both models share. A rare
    word takes the counts of its longest stem that tells: one in `rare` documents or more whose rates differ by
    exp(gap) and by more than chance (chi-square `sure`). A stem in `often` documents that does not tell is as
    likely in both classes, whatever shorter stems say. Counts are summed on Spark; the driver gets the
    stems that tell, and the frequent ones, bounded by per_class.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    rate = F.when(F.col("y") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    sample = known.where(uniform("id") < rate).withColumn("fold", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)) == 0).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(small_or_shuffled(sample, 4 * per_class), "id")

    def count(batches):
        seen = (Counter(), Counter())

        def close():
            own = sorted(seen[0].keys() | seen[1].keys())
            out = pa.record_batch([pa.array(own, pa.string()), *(pa.array([c[x] for x in own], pa.int64()) for c in seen)], names=["x", "n0", "n1"])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update({x for w in set(words(text)) for x in stems(w, shortest)} | {""})
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield close()
        yield close()

    with Scratch(spark) as scratch:
        got = rows.where("fold = 0").select(F.col("y").cast("int").alias("y"), "text").mapInArrow(count, "x string, n0 bigint, n1 bigint")
        counts = scratch.written(got.groupBy("x").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "stems")
        size = counts.where("x = ''").first()
        kinds = counts.where("x <> ''").agg(F.count_if(F.col("n0") > 0), F.count_if(F.col("n1") > 0)).first()
        if size is None or not size["n0"] or not size["n1"]:
            return None
        made = ratios(counts.where("x <> ''"), (size["n0"], size["n1"]), tuple(kinds), discount, rare, often, gap, sure).toArrow()
    model = {"ratio": dict(zip(made["x"].to_pylist(), made["ratio"].to_pylist())), "shortest": shortest, "prior": prior, "scale": 1.0, "bias": 0.0}
    seen = log_ratios(rows.where("fold = 1"), model, keep=("y",)).toArrow()
    y, x = seen["y"].to_numpy().astype(float), bent(seen["ratio"].to_numpy())
    weight = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
    if len(set(y)) == 2:
        model["scale"], model["bias"] = _logistic(x, y, weight / weight.mean())
    else:
        model["scale"], model["bias"] = 1.0, float(np.log(n[1] / n[0]))
    return model


def ratios(counts: DataFrame, docs: tuple[int, int], kinds: tuple[int, int], discount: float, rare: int, often: int, gap: float, sure: float) -> DataFrame:
    """(x, ratio) for the expressions of counts (x, n0, n1) that tell, and ratio 0 for other frequent ones.

    docs and kinds are, for each class, its documents and its distinct expressions.
    """
    shared = (F.when(F.col("n0") > 0, 1).otherwise(0) + F.when(F.col("n1") > 0, 1).otherwise(0)) / F.lit(float(sum(kinds)))
    p = [(F.greatest(F.col(f"n{k}") - discount, F.lit(0.0)) + discount * kinds[k] * shared) / docs[k] for k in (0, 1)]
    both = F.col("n0") + F.col("n1")
    due = both * (docs[1] / sum(docs))
    chance = (F.col("n1") - due) ** 2 * (1 / due + 1 / (both - due))
    ratio = F.log(p[1]) - F.log(p[0])
    tells = (both >= rare) & (F.abs(ratio) >= gap) & (chance >= sure)
    return counts.where(tells | (both >= often)).select("x", F.when(tells, ratio).otherwise(0.0).alias("ratio"))


def bent(ratio):
    """Mean ratios spread over orders of magnitude: few of a toxic text's words are toxic. Keeps sign and order."""
    return np.sign(ratio) * np.log1p(np.abs(ratio) / 0.01)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one standardised variable by Newton steps with a small ridge."""
    mid, spread = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    z = np.stack([(x - mid) / spread, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-2 * w * [1, 0]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mid / spread)


def word_ratio(word: str, model: dict) -> float:
    """Log-likelihood ratio of a word: that of its longest known stem, itself first; 0 without one."""
    known = model["ratio"]
    for x in stems(word, model["shortest"]):
        if x in known:
            return known[x]
    return 0.0


def log_ratios(docs: DataFrame, model: dict, keep=("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep and ratio: toxic minus ordinary log-likelihood a word (0 without words).

    `prior` words that both classes judge alike are added to every text, so that one word does not decide on a tiny one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, known = shared.value, {}
        for batch in batches:
            out = []
            for text in batch.column(len(keep)).to_pylist():
                own, total = words(text), 0.0
                for w in own:
                    r = known.get(w)
                    if r is None:
                        r = known[w] = word_ratio(w, m)
                    total += r
                out.append(total / (len(own) + m["prior"]))
                if len(known) > 400_000:
                    known.clear()
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.float64())], names=[*keep, "ratio"])

    return docs.select(*keep, text_col).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", ratio double")


def score(docs: DataFrame, model: dict | None, keep=("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep, score (0 to 1) and predicted (1 from 0.5) for every row.

    The score is the calibrated log-likelihood ratio a word, over the whole text however long. Null
    and empty texts score as a ratio of 0; without a model every score is 0. Repeated rows each give
    a row; an empty table an empty result.
    """
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    x = F.signum("ratio") * F.log1p(F.abs("ratio") / 0.01)
    p = 1 / (1 + F.exp(-(x * model["scale"] + model["bias"])))
    return log_ratios(docs, model, keep, text_col).select(*keep, p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
