"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, spread_join

#: The printable stand-ins that byte-level vocabularies use for the 256 bytes.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _KEPT} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _KEPT)}
_ENCODERS: dict[str, object] = {}


def version(tokenizer: str) -> str:
    """Digest of a tokenizer file: another file never shares stored counts."""
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def counter(tokenizer: str):
    """A function from texts to token counts, once per worker.

    .model files go to sentencepiece and .json files to tokenizers. A .json file that is plain
    byte-level BPE whose merges are in order of their ids is run by tiktoken, which gives the same
    ids several times faster (the tests compare both).
    """
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = _counter(tokenizer)
    return _ENCODERS[tokenizer]


def _counter(tokenizer: str):
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    spec = json.loads(Path(tokenizer).read_text(encoding="utf8"))
    ranks = _ranks(spec)
    if ranks:
        import public_tokenizers
        import tiktoken

        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        fast = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [len(fast.encode(x, allowed_special="all")) for x in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    slow.no_truncation()
    slow.no_padding()
    return lambda texts: [len(x.ids) for x in slow.encode_batch(texts, add_special_tokens=False)]


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by token bytes if the file is byte-level BPE without other steps, else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and spec.get("normalizer") is None
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
    )
    if not plain:
        return None
    added = {x["content"] for x in spec["added_tokens"]}
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + n for n, (a, b) in enumerate(merges)):
        return None
    return {bytes(_BYTES[c] for c in word): n for word, n in model["vocab"].items() if word not in added}


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text_col: str = "text", limit: int = 1024, keep=("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns in keep, n_bytes, n_tokens, over_limit.

    Content is normalised only by reading null as the empty text, since any other change would
    change counts. Its digest and the tokenizer file's digest are joined to the cache, a Parquet
    folder (digest, version, n_tokens); each distinct text that is missing is encoded once and
    appended. Texts that very many rows repeat are joined by broadcast, so that none is a hot key. cache=None starts an empty cache in the shared folder. Copies are combined before the
    shuffle, so a text that a third of the rows repeat reaches the encoder once a map task. Empty
    texts count 0 tokens; repeated rows each give a row; extra columns are not read; an empty table
    gives an empty result and appends nothing.
    """
    spark: SparkSession = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    made = version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    stored = _stored(spark, cache).where(F.col("version") == made)
    known = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    distinct = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    missing = distinct.join(known.select("digest"), "digest", "left_anti") if not stored.isEmpty() else distinct

    def encode(batches):
        count = counter(tokenizer)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    fresh = missing.mapInArrow(encode, "digest binary, n_tokens bigint")
    fresh.select("digest", F.lit(made).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    known = _stored(spark, cache).where(F.col("version") == made).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(F.struct(*keep).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    found = spread_join(rows, known, ["digest"])
    return found.select("own.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    schema = "digest binary, version string, n_tokens bigint"
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)
