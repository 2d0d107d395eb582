"""A corpus pipeline of five stages; each reads what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqaudit.llm import byte_bpe, decontamination, jaccard_join, quality, secrets
from seqaudit.llm.common import row_key, small_or_shuffled, table, without, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8.

    The least id stays (without one only where the whole group has none). Each pair of id and text is a document of its
    own, whatever else has its id, and repeated rows become one. Such documents are told apart by a 64-bit hash.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    found = jaccard_join.classes(docs.select(key, "text"), k=5, percent=80, id_col="key")
    ids = docs.select(key, F.col("doc_id").alias("id")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    ids = ids.join(found.select("key", F.col("component_id").alias("group")).distinct(), "key")
    first = F.min(F.struct(F.col("id").isNull(), "id", "key", "n")).alias("x")
    stay = written(ids.groupBy("group").agg(first).select("x.key", "x.n"), "staying")
    own = docs.select(key, F.struct(*docs.columns).alias("own")).join(small_or_shuffled(stay, 200_000), "key")
    once = own.where("n = 1").select("own.*")
    return once if stay.where("n > 1").isEmpty() else once.unionByName(own.where("n > 1").dropDuplicates(["key"]).select("own.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; one without an id or with a repeated one is judged like any other."""
    keyed = docs.select(F.struct(*row_key("text")).alias("id"), "text")
    leaks = decontamination.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="id")
    return without(docs, written(leaks.select("id.*").distinct(), "leaks"), ("text",))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark and n_chars counted again; other columns may have any name."""
    own = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("own"), "text")
    found = secrets.scan(own, secrets.train(docs), keep=("own",))
    return found.select(*[F.col("redacted").alias(c) if c == "text" else F.length("redacted").cast("bigint").alias(c) if c == "n_chars" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL can express neither the estimates, the network nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
