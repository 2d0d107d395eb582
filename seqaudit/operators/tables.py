"""Joins, aggregations and set operations on tables of samples, scores and factors."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_compound(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which a compound predicate is true; null is not true."""
    return df.where(predicate)


def assemble_features(df: DataFrame, prefix: str = "emb_", id_col: str = "sequence_id", external: DataFrame | None = None) -> DataFrame:
    """features: the columns named prefix... in order of name as one array, or the `features` of an external table (id_col, features).

    The external table must have as many rows as df and one for every id, else a ValueError says so.
    """
    if external is None:
        cols = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: (len(c), c))
        return df.select(*[c for c in df.columns if c not in cols], F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))
    got = df.join(external.select(id_col, "features"), id_col)
    counts = df.count(), external.count(), got.count()
    if len({*counts}) > 1:
        raise ValueError(f"{counts[0]} rows, {counts[1]} feature rows, {counts[2]} that meet")
    return got


def join_scores(samples: DataFrame, scores: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Every sample with the columns of its scores (null without) and matched, 0 or 1; scores has one row a key."""
    own = scores.withColumnRenamed(right_on, "_key").withColumn("matched", F.lit(1))
    return samples.join(own, samples[left_on] == own["_key"], "left").drop("_key").withColumn("matched", F.coalesce("matched", F.lit(0)))


def lookup_attrs(df: DataFrame, dim: DataFrame, key: str, dim_key: str, cols: list[str]) -> DataFrame:
    """Rows with the named columns of their row in a table of attributes; rows without one go."""
    own = dim.select(F.col(dim_key).alias("_key"), *cols)
    return df.join(own, df[key] == own["_key"]).drop("_key")


def median_by_name(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Exact medians of the columns by key; nulls are left out."""
    return df.groupBy(key).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in cols])


def any_yes(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """1 where any row of the key says yes (in any case), else 0."""
    return df.groupBy(key).agg(*[F.max(F.coalesce((F.lower(F.trim(c)) == "yes").cast("int"), F.lit(0))).alias(c) for c in cols])


def factor_scores(factors: DataFrame, row_key: str, flag: str) -> DataFrame:
    """By row: number and weight of its factors, and the weight of flagged (0/1) and of other ones."""
    w, f = F.col("weighted"), F.col(flag)
    return factors.groupBy(row_key).agg(F.count("*").alias("n_factors"), F.sum(w).alias("total"), F.sum(w * f).alias("circular"), F.sum(w * (1 - f)).alias("ablated"))


def factor_catalog(factors: DataFrame) -> DataFrame:
    """How often each factor name occurs."""
    return factors.groupBy("name").agg(F.count("*").alias("n"))


def pivot_fragments(pairs: DataFrame, key: str, col: str, values: list, value: str) -> DataFrame:
    """A column for each of the values of col with the mean of value, by key; the values are given, so no pass finds them."""
    return pairs.groupBy(key).pivot(col, values).agg(F.avg(value))


def capped_sample(df: DataFrame, by: str, col: str, n: int = 50) -> DataFrame:
    """The first n distinct values of col for each `by`, as an ordered array; copies are combined before the shuffle."""
    from .intervals import top_positions

    one = df.select(F.col(by).alias("accession"), F.col(col).alias("pos")).where("pos is not null").distinct().withColumn("attr", F.lit(0))
    return top_positions(one, n).groupBy(F.col("accession").alias(by)).agg(F.array_sort(F.collect_list("pos")).alias("first"))


def union_models(tables: dict[str, DataFrame], tag_col: str) -> DataFrame:
    """The rows of all tables under each other, tagged with their names."""
    return functools.reduce(DataFrame.unionByName, [df.withColumn(tag_col, F.lit(name)) for name, df in tables.items()])


def intersect_ids(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column that both tables have."""
    return a.select(col).intersect(b.select(col))


def fidelity(df: DataFrame, rebuilt: str, published: str, share: str) -> DataFrame:
    """One row: rank correlation of rebuilt and published scores, and the median share of circular weight."""
    from .statistics import spearman

    rho = spearman(df.withColumn("_all", F.lit(1)), rebuilt, published, ["_all"]).drop("_all")
    return rho.join(F.broadcast(df.agg(F.percentile(share, F.lit(0.5)).alias("median_share"))), F.lit(True))
