"""Splits and resampling with keyed-hash randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join
from ..functions.keyed import draw, shuffled_place
from .draws import resampled_ranks
from .statistics import run_up


def group_split(df: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """split: val for ceil(test_size * groups) of the groups, the first in hash order, train for the others; null groups go."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    n = F.broadcast(groups.agg(F.count("*").alias("_groups")))
    ranked = hash_rank(groups, group, seed).join(n, F.lit(True)).withColumn("split", F.when(F.col("_rank") < F.ceil(F.col("_groups") * test_size), "val").otherwise("train"))
    return df.join(ranked.drop("_rank", "_groups"), group)


def oversample_minority(df: DataFrame, label: str) -> DataFrame:
    """Repeat rows of the smaller class floor(larger / smaller) times. Rows without a label count for no class and stay once; an error with under two classes."""
    n = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if len(n) < 2:
        raise ValueError("a class is empty")
    small = min(n, key=lambda k: (n[k], k))
    times = F.when(F.col(label) == small, max(n.values()) // n[small]).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def hash_rank(df: DataFrame, id_col: str, seed: int, out: str = "_rank", buckets: int = 4096, by: tuple[str, ...] = ()) -> DataFrame:
    """out: the rank, from 0, of every row by keyed hash of its id, ties by id; among the rows of its key with by. A null key is a key.

    Hashes are even, so equal ranges of them are even buckets: rows are ranked within theirs, and a table of `buckets`
    counts a key gives what lies before. No task sees all rows, or all of a key.
    """
    marked = df.withColumn("_h", draw(seed, F.col(id_col))).withColumn("_b", F.floor(F.col("_h") / F.lit((1 << 32) // buckets)))
    counts = marked.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_b", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = marked.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_col)) - 1)
    met = null_safe_join(own, before, [*by, "_b"]) if by else own.join(F.broadcast(before), "_b")
    return met.withColumn(out, F.col("_before") + F.col("_at")).drop("_b", "_h", "_at", "_before")


def kfold_random(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold: rows dealt in hash order, so that folds differ by one row at most; a null id is hashed as an empty one."""
    return hash_rank(df, id_col, seed).withColumn("fold", F.pmod(F.col("_rank"), F.lit(k))).drop("_rank")


def group_fold_random(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold: groups dealt in hash order, all rows of a group with it; null groups go."""
    groups = df.select(group).distinct()
    return df.join(kfold_random(groups, group, k, seed), group)


def shared_block_fraction(df: DataFrame, id_col: str, block: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Under random folds, the share of test rows whose block is in training too, mean over folds; null under 2 k rows."""
    dealt = kfold_random(df, id_col, k, seed)
    per = dealt.groupBy(block, "fold").agg(F.count("*").alias("n"))
    per = per.withColumn("all", F.sum("n").over(Window.partitionBy(block)))
    folds = per.groupBy("fold").agg((F.sum(F.when(F.col("all") > F.col("n"), F.col("n")).otherwise(0)) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    return folds.agg(F.when(F.sum("n") >= 2 * k, F.avg("x")).alias("shared_block_fraction"))


def _placed(df: DataFrame, id_col: str, stratum: str | None, b: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their rank (_i) in their stratum, and these once a permutation with the rank (_j) whose label they get."""
    by = (stratum,) if stratum else ()
    rows = hash_rank(df, id_col, seed, "_i", by=by)
    size = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.explode(F.sequence(F.lit(0), F.lit(min(b, 64) - 1))).alias("_chunk")  # few rows make many, so they are dealt out first
    each = null_safe_join(rows, size, list(by)).select("*", chunk).repartition(parts, "_chunk", "_i")
    each = each.select("*", F.explode(F.sequence(F.col("_chunk") + 1, F.lit(b), F.lit(min(b, 64)))).alias("perm")).drop("_chunk")
    return rows, shuffled_place(each, "_i", "_n", [seed, F.col("perm"), *map(F.col, by)], "_j").drop("_n")


def label_perm(df: DataFrame, id_col: str, y: str, stratum: str | None, b: int, seed: int = 42) -> DataFrame:
    """(perm, id, permuted): labels shuffled within strata (all rows without one), b times.

    Each row computes the place whose label it gets (`shuffled_place`), so a permutation is one join on (stratum, place) and no stratum is sorted
    or held by one task. A null stratum is one of its own; rows that repeat an id are shuffled like others.
    """
    by = [stratum] if stratum else []
    own = df.select(*by, F.col(id_col).alias("id"), F.col(y).alias("permuted"))
    rows, placed = _placed(own, "id", stratum, b, seed)
    labels = rows.select(*by, F.col("_i").alias("_j"), "permuted")
    return null_safe_join(placed.drop("permuted"), labels, [*by, "_j"]).select("perm", "id", "permuted")


def group_bootstrap(df: DataFrame, group: str, a: str, b: str, reps: int, seed: int = 42, min_n: int = 10) -> DataFrame:
    """Spearman of each replicate in which groups are drawn with replacement; null under min_n rows and where a side is constant. Groups are numbered by hash.

    Rows are counted by group and pair of values once, and replicates weigh these counts inside tasks (`resampled_ranks`).
    """
    rows = df.select(F.col(group).alias("grp"), F.col(a).alias("x"), F.col(b).alias("y"))
    groups = hash_rank(rows.where("grp is not null").select("grp").distinct(), "grp", seed, "g")
    known = rows.where("x is not null and y is not null").join(groups, "grp").groupBy("g", "x", "y").agg(F.count("*").alias("w"))
    at = lambda c: run_up(known.select(c).distinct().withColumn("_one", F.lit(1)), [], c, ["_one"]).select(c, F.col("_one_under").cast("bigint").alias(f"{c}_at"))
    cells = known.join(at("x"), "x").join(at("y"), "y").select("g", F.col("x_at").alias("x"), F.col("y_at").alias("y"), "w")
    sums = resampled_ranks(cells, groups.count(), reps, seed)
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select("rep", "n", F.when((F.col("n") >= min_n) & (spread > 0), F.col("xy") / spread).alias("rho"))
