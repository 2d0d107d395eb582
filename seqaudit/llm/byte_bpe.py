"""Byte-level BPE by a global shuffle of distinct words."""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def _encoding(path: str):
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        _LOADED[path] = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _LOADED[path]


def _pack(items: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, items), np.uint32, len(items)).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(items)).tobytes() + sizes + b"".join(items))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist())]


def pre_tokens(docs: DataFrame, id_col: str, text_col: str, words_in_chunk: int, buckets: int) -> DataFrame:
    """Explode texts to pre-tokens with positions, packed by chunk of whole documents.

    A chunk has rows of two kinds. One has dest = the chunk, and the ids, lengths and word numbers of its
    documents in order (the positions). The others have dest = -1 - bucket, and the chunk's distinct words whose
    hash falls in the bucket. A chunk closes after words_in_chunk pre-tokens; one longer text is a chunk.
    A chunk's key is a digest of its place and texts, so words never meet positions of another reading of it.
    """
    names = ["dest", "chunk", "keys", "lengths", "blob"]

    def cut(batches):
        import public_tokenizers
        import regex
        import xxhash
        from pyspark import TaskContext

        split = regex.compile(public_tokenizers.PATTERN).findall
        part, serial = TaskContext.get().partitionId(), 0
        ids, codes, numbers, held, read = [], [], {}, 0, xxhash.xxh3_64()

        def close():
            words = [w.encode() for w in numbers]
            where = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            groups = np.split(order, cuts) if len(order) else []
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            coded = rank[np.concatenate(codes)] if len(order) else np.zeros(0, np.int64)
            lengths = [len(x) for x in codes]
            read.update(f"{part} {serial}")
            chunk = read.intdigest() >> 1
            rows = [(chunk, None, ids, lengths, zstandard.ZstdCompressor(level=1).compress(_narrow(coded, len(order))))]
            rows += [(-1 - int(where[g[0]]), chunk, None, None, _pack([words[i] for i in g])) for g in groups]
            types = [pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = split(text) if text else []
                read.update(f"{key} {text}".encode())
                codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in got), np.uint32, len(got)))
                ids.append(key)
                held += len(got)
                if held >= words_in_chunk:
                    yield close()
                    serial, held, ids, codes, numbers, read = serial + 1, 0, [], [], {}, xxhash.xxh3_64()
        if ids:
            yield close()

    schema = f"dest bigint, chunk bigint, keys array<{docs.schema[id_col].dataType.simpleString()}>, lengths array<bigint>, blob binary"
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def _planes(x: np.ndarray, size: int) -> bytes:
    """Numbers under size as planes of bytes, which compress apart."""
    return b"".join(((x >> s) & 255).astype(np.uint8).tobytes() for s in range(0, _bits(size), 8))


def _from_planes(raw: bytes, n: int, at: int, size: int) -> np.ndarray:
    return sum((np.frombuffer(raw, np.uint8, n, at + i * n).astype(np.int64) << 8 * i for i in range(_bits(size) // 8)), np.zeros(n, np.int64))


def _bits(size: int) -> int:
    return 24 if size <= 1 << 24 else 32


def _narrow(codes: np.ndarray, size: int) -> bytes:
    """Word numbers by frequency, which makes most of them small, and the numbers they stand for."""
    by_count = np.argsort(-np.bincount(codes, minlength=size), kind="stable")
    rank = np.empty(size, np.int64)
    rank[by_count] = np.arange(size)
    return np.array([len(codes), size], np.uint32).tobytes() + _planes(by_count, size) + _planes(rank[codes], size)


def _wide(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, size = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
    return _from_planes(raw, size, 8, size)[_from_planes(raw, n, 8 + size * _bits(size) // 8, size)]


def _width(rank_file: str):
    """The narrowest whole numbers that hold the ranks."""
    return np.uint16 if max(ranks(rank_file).values()) < 1 << 16 else np.uint32


def encode_words(dealt: DataFrame, rank_file: str) -> DataFrame:
    """(dest, bucket, ids): the ids of each chunk's words in a bucket; every distinct word of a bucket is encoded once.

    Reads the rows of dealt with words, sorted by dest, and passes over the others.
    """

    def encode(batches):
        encoding, bucket, known, width = _encoding(rank_file), None, {}, _width(rank_file)
        for batch in batches:
            out = []
            for dest, chunk, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4))):
                if dest >= 0:
                    continue
                if dest != bucket:
                    bucket, known = dest, {}
                ids = []
                for w in _unpack(blob):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(encoding.encode_ordinary(w.decode()), width).tobytes()
                    ids.append(got)
                out.append((chunk, -1 - dest, _pack(ids)))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.binary()))], names=["dest", "bucket", "ids"])

    return dealt.sortWithinPartitions("dest").mapInArrow(encode, "dest bigint, bucket bigint, ids binary")


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", words_in_chunk: int = 1_000_000, buckets: int | None = None, digests: bool = False) -> DataFrame:
    """One row per document: id_col, n_tokens and ids (array<int>), or with digests=True the ids'
    and the decoded bytes' SHA-256 in place of the ids.

    Null and empty texts have no ids; repeated rows each give a row; ids may have any type; extra columns are not read; an
    empty table gives an empty result. Pre-tokens are cut once and shuffled once: positions to
    their chunk's partition, a chunk's distinct words to their bucket's, so no word is a hot key. Ids go back to
    the chunk, which the join finds in place. Decoding looks each id up in the token-byte table of the rank file.
    docs should be a table, or a plan that gives its rows in the same order when an executor is lost; if it
    does not, the job fails rather than mixing chunks up.
    """
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pre_tokens(docs, id_col, text_col, words_in_chunk, buckets or 4 * shuffled).repartition(shuffled, "dest")
    packed = encode_words(dealt, rank_file).groupBy("dest").agg(F.array_sort(F.collect_list(F.struct("bucket", "ids"))).alias("words"))
    rows = dealt.join(packed, "dest", "left")  # all columns stay, so that both uses of dealt are one shuffle
    kind = docs.schema[id_col].dataType.simpleString()

    def assemble(batches):
        table: list[bytes] = []
        width = _width(rank_file)
        for batch in batches:
            arrow = batch.schema.field("keys").type.value_type
            for dest, keys, lengths, blob, words in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("dest", "keys", "lengths", "blob", "words"))):
                if dest < 0:
                    continue
                if digests and not table:
                    by_id = {n: b for b, n in ranks(rank_file).items()}
                    table = [by_id.get(n, b"") for n in range(max(by_id) + 1)]
                word_ids = [np.frombuffer(x, width) for w in words or [] for x in _unpack(w["ids"])]
                codes, at, out = _wide(blob), 0, []
                if len(codes) and codes.max() >= len(word_ids):
                    raise ValueError("the words of a chunk are missing: its texts came in another order when they were read again")
                counts = np.fromiter(map(len, word_ids), np.int64, len(word_ids))
                if digests:
                    texts = [",".join(map(str, x.tolist())) for x in word_ids]
                    decoded = [b"".join([table[i] for i in x.tolist()]) for x in word_ids]
                for key, n in zip(keys, lengths):
                    own = codes[at : at + n]
                    at += n
                    if digests:
                        listed = own.tolist()
                        a = hashlib.sha256(",".join([texts[i] for i in listed]).encode()).hexdigest()
                        b = hashlib.sha256(b"".join([decoded[i] for i in listed])).hexdigest()
                        out.append((key, int(counts[own].sum()), a, b))
                    else:
                        out.append((key, int(counts[own].sum()), np.concatenate([word_ids[i] for i in own]).astype(np.int32) if n else []))
                types = [arrow, pa.int64(), pa.string(), pa.string()] if digests else [arrow, pa.int64(), pa.list_(pa.int32())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_col, "n_tokens", "ids"]
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out), types)], names=names)

    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return rows.mapInArrow(assemble, f"`{id_col}` {kind}, n_tokens bigint, {tail}")


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary): each id joined to its bytes in the token-byte table.

    The table is broadcast: its size is the vocabulary's. Null or empty ids give empty bytes.
    """
    spark = encoded.sparkSession
    by_id = {n: b for b, n in ranks(rank_file).items()}
    table = spark.sparkContext.broadcast([by_id.get(n, b"") for n in range(max(by_id) + 1)])

    def join(batches):
        for batch in batches:
            got = [b"".join([table.value[i] for i in x or []]) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(got, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(join, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")
