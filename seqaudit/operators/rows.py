"""Row filters, keys and sequence expressions. Each takes a DataFrame and returns one."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_rows(df: DataFrame, label: str, features: str | None = None) -> DataFrame:
    """Rows whose label, and every feature in an array column, are finite."""
    kept = df.where(finite(F.col(label)))
    return kept.where(F.forall(features, finite)) if features else kept


def coerce_label(df: DataFrame, col: str) -> DataFrame:
    """The column as a double; null where it is no number."""
    return df.withColumn(col, F.expr(f"try_cast(`{col}` as double)"))


def label_kind(df: DataFrame, label: str, mode: str = "exact2") -> DataFrame:
    """One row: is the label binary. upto2 and round2 round first; exact2 does not."""
    x = F.col(label) if mode == "exact2" else F.round(label)
    n = F.count_distinct(x)
    return df.where(finite(F.col(label))).agg(n.alias("n_values"), ((n <= 2) if mode == "upto2" else (n == 2)).alias("is_binary"))


def fill_default(df: DataFrame, col: str, value: Column) -> DataFrame:
    """Nulls of a column replaced by a value or another column's."""
    return df.withColumn(col, F.coalesce(col, value))


def dedupe_key(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where("_n = 1").drop("_n")


def row_id(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """row_id: the id as text, or where it is null 40 digits of the sequence's SHA-256 (null if both are)."""
    return df.withColumn("row_id", F.coalesce(F.col(id_col).cast("string"), F.substring(F.sha2(seq_col, 256), 1, 40)))


def membership_flag(df: DataFrame, key: str, panel: DataFrame) -> DataFrame:
    """in_panel: 1 where the key is in the panel."""
    own = panel.select(key).distinct().withColumn("in_panel", F.lit(1))
    return df.join(own, key, "left").withColumn("in_panel", F.coalesce("in_panel", F.lit(0)))


def clip_log_ratio(df: DataFrame, ratio: str, scale: float = 0.25, bound: float = 3.0) -> DataFrame:
    """z: the log ratio over scale, held within the bound; null where the ratio is not finite and positive."""
    z = F.greatest(F.least(F.log(ratio) / scale, F.lit(bound)), F.lit(-bound))
    return df.withColumn("z", F.when(finite(F.col(ratio)) & (F.col(ratio) > 0), z))


def safe_ratio(df: DataFrame, num: str, den: str, eps: float | None = None) -> DataFrame:
    """ratio: null where the denominator is 0, or eps added to it."""
    return df.withColumn("ratio", F.col(num) / (F.col(den) + eps) if eps else F.col(num) / F.nullif(F.col(den), F.lit(0)))


def gc_full(df: DataFrame, seq: str) -> DataFrame:
    """Share of G and C among all letters."""
    n = F.length(seq)
    return df.withColumn("gc", (n - F.length(F.translate(seq, "GCgc", ""))) / F.nullif(n, F.lit(0)))


def gc_acgt(df: DataFrame, seq: str) -> DataFrame:
    """Share of G and C among A, C, G and T."""
    own = F.regexp_replace(F.upper(seq), "[^ACGT]", "")
    return df.withColumn("gc", (F.length(own) - F.length(F.translate(own, "GC", ""))) / F.nullif(F.length(own), F.lit(0)))


def dinuc_frac(df: DataFrame, seq: str, dinuc: str) -> DataFrame:
    """Share of overlapping pairs that are dinuc, other letters dropped first; null under two letters. One pass over the text."""
    own = F.regexp_replace(F.upper(seq), "[^ACGT]", "")
    return df.withColumn("frac", F.regexp_count(own, F.lit(f"(?={dinuc})")) / F.nullif(F.greatest(F.length(own) - 1, F.lit(0)), F.lit(0)))


def kmer_counts(df: DataFrame, key: str, seq: str, k: int = 3) -> DataFrame:
    """(key, kmer, n, freq); letters other than A, C, G, T are removed first, so k-mers bridge gaps.

    K-mers are counted in tasks, over a batch's rows of a key together, so texts give a row for each of their distinct k-mers and letters are no rows.
    Null texts and those under k letters give no row; rows that repeat a key count together.
    """
    others = bytes(set(range(256)) - set(b"ACGT"))

    def counted(batches):
        for batch in batches:
            first, sums = {}, {}
            for i, (name, x) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                x = x.upper().encode().translate(None, others).decode()
                at = first.setdefault(name if name.__hash__ else i, i)  # keys that are lists or structs are summed by Spark alone
                sums.setdefault(at, Counter()).update([x[j : j + k] for j in range(len(x) - k + 1)])
            own = pa.array([i for i, c in sums.items() for _ in c], pa.int64())
            columns = [pa.array([m for c in sums.values() for m in c], pa.string()), pa.array([n for c in sums.values() for n in c.values()], pa.int64())]
            yield pa.record_batch([batch.column("key").take(own), *columns], names=["key", "kmer", "n"])

    long = df.select(F.col(key).alias("key"), F.col(seq).alias("text")).where("text is not null")
    each = long.mapInArrow(counted, f"key {df.schema[key].dataType.simpleString()}, kmer string, n bigint")
    counts = each.groupBy(F.col("key").alias(key), "kmer").agg(F.sum("n").alias("n"))
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def parse_factors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, weighted, risk_score, impact) from blocks of free text; a block needs a name and a weight.

    A number is digits and dots; one that is no number, as a lone dot, counts as absent.
    """
    block = F.explode(F.split(text, r"\n(?=Risk Name:)")).alias("block")
    name = F.nullif(F.trim(F.regexp_extract("block", r"Risk Name:\s*([^\n]+)", 1)), F.lit(""))
    number = lambda field: F.regexp_extract("block", rf"{field}:\s*([0-9.]+)", 1).try_cast("double")
    got = df.select(key, block).select(key, name.alias("name"), number("Weighted Score").alias("weighted"), number("Risk Score").alias("risk_score"), number("Impact Score").alias("impact"))
    return got.where("name is not null and weighted is not null")


def flag_factors(factors: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One 0/1 column a pattern, matched in the name without regard to case."""
    return factors.select("*", *[F.col("name").rlike(f"(?i){p}").cast("int").alias(c) for c, p in patterns.items()])
