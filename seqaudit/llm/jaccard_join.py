"""N-gram Jaccard join over prefix trees of globally ordered shingle sets."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, let, small_or_shuffled, spread_join, written

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_WORDS: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The text's distinct k-word shingles as 64-bit hashes in the global order, that of the hashes.

    Words are runs outside 20 and 09-0D, A-Z lower-cased; fewer than k words are one shingle.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 100_000:
        _WORDS.clear()
    get = _WORDS.get
    hashes = [get(w) for w in words]
    if None in hashes:
        for n, (h, w) in enumerate(zip(hashes, words)):
            if h is None:
                hashes[n] = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array(hashes, np.uint64)
    runs = h[: len(h) - k + 1] if len(h) >= k else h[:1]
    width = min(k, len(h))
    out = np.full(len(runs), width, np.uint64)
    for j in range(width):
        out = _mixed(out * _MIX[0] + h[j : j + len(runs)])
    return np.unique(out)


#: Bits of a set's parity: each shingle flips one.
_PARITY = 512


def parity(ordered: np.ndarray) -> list[int]:
    """For each of so many equal parts of the hashes, whether the set has an odd number there, as 64-bit integers."""
    odd = np.bincount((((ordered >> np.uint64(32)) * np.uint64(_PARITY)) >> np.uint64(32)).astype(np.int64), minlength=_PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def _bounds(limit: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


_BOUNDS = _bounds()


def signatures(ordered: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, class, least): digests of the segments of an ordered set, and how many a partner shares.

    Sizes fall in classes [lo, hi). Two sets of sizes s <= t whose intersection is percent of the
    union differ in at most (s + t)(100 - percent) // (100 + percent) shingles. With s in the class that
    is k = (hi - 1)(100 - percent) // percent at most, and the order is cut in more than k segments; a segment that
    is the same in both sets is an edge that both paths of the prefix tree have in common. A
    difference spoils one segment in each set at the same place, so all but so many are the same: `least`
    for the largest partner that the set may have. A set lists the segments of its own class and of
    each lower class in which a partner may lie.
    """
    n = len(ordered)
    own = int(np.searchsorted(_BOUNDS, n, side="right")) - 1
    digests, kinds, least = [], [], []
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(ordered), dtype=np.uint64)))
    while own >= 0 and 100 * (_BOUNDS[own + 1] - 1) >= percent * n:
        small = min(n, _BOUNDS[own + 1] - 1)
        differ = (_BOUNDS[own + 1] - 1) * (100 - percent) // percent
        parts = differ + 1 + differ // 2
        most = (small + min(small * 100 // percent, n * 100 // percent)) * (100 - percent) // (100 + percent)
        if small < n:
            most = max(most, (small + n) * (100 - percent) // (100 + percent))
        part = ((ordered >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        counts = np.bincount(part.astype(np.int64), minlength=parts)
        ends = np.cumsum(counts)
        digest = sums[ends] - sums[ends - counts]
        place = np.arange(parts, dtype=np.uint64) + np.uint64(own << 40)
        digests.append(_mixed(digest + _MIX[1] * place + _MIX[3] * counts.astype(np.uint64)))
        kinds.append(np.full(parts, own, np.int32))
        least.append(np.full(parts, max(1, parts - most), np.int32))
        own -= 1
    return np.concatenate(digests), np.concatenate(kinds), np.concatenate(least)


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def packed(docs: DataFrame, k: int, percent: int, buckets: int, flush: int = 300_000) -> DataFrame:
    """(bucket, n, blob): one pass over docs (id, text).

    A chunk of documents gives a row for each bucket of its segments' digests, with n segments, and one with n = -1 for
    the sizes and digests of all its sets. Copies within a chunk post their segments once. 32 bits of a digest go besides its
    bucket: segments that are alike by chance only make candidates, which are compared in full.
    """

    def post(batches):
        from pyspark import TaskContext

        part, serial, sizes, ids, sigs, held, seen = TaskContext.get().partitionId(), 0, [], [], [], 0, set()

        def close():
            keys, n, high, low = zip(*sizes)
            known = np.array([i is not None for i in keys])
            rows = [((part * 7919 + serial) % buckets, -1, _blob(np.array([i or 0 for i in keys], np.int64), np.array(n, np.int64), np.array(high, np.int64), np.array(low, np.int64), known))]
            if sigs:
                s, c, least = (np.concatenate(x) for x in zip(*sigs))
                d = np.repeat(np.array([i for i, _ in ids], np.int64), [n for _, n in ids])
                where = (s % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                    digest = (s[own] >> np.uint64(32)).astype(np.uint32)
                    rows.append((int(where[own[0]]), len(own), _blob(np.diff(d[own], prepend=0), c[own].astype(np.int32), least[own].astype(np.int32), digest)))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "n", "blob"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shingle_set(text, k)
                digest = (0, 0)
                if len(own):
                    mixed = _mixed(own + _MIX[3])
                    digest = int(np.bitwise_xor.reduce(mixed).view(np.int64)), int(mixed.sum(dtype=np.uint64).view(np.int64))
                sizes.append((key, len(own), *digest))
                if len(own) and key is not None and digest not in seen:
                    seen.add(digest)
                    got = signatures(own, percent)
                    ids.append((key, len(got[0])))
                    sigs.append(got)
                    held += len(got[0])
                if held >= flush or len(sizes) >= flush:
                    yield close()
                    serial, sizes, ids, sigs, held, seen = serial + 1, [], [], [], 0, set()
        if sizes:
            yield close()

    return docs.mapInArrow(post, "bucket bigint, n bigint, blob binary")


def meetings(packed: DataFrame) -> DataFrame:
    """(id, kind, least, times, sig): segments that more than one document has, and how many have them.

    Rows of kind -1 are the documents' sizes: least is the size, times and sig the digest.
    """
    names = ["id", "kind", "least", "times", "sig"]

    def meet(batches):
        bucket, held = None, []

        def shared():
            d, c, least, s = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(s, kind="stable")
            lead = np.flatnonzero(np.concatenate(([True], s[order][1:] != s[order][:-1])))
            times = np.empty(len(s), np.int64)
            times[order] = np.repeat(np.diff(np.append(lead, len(s))), np.diff(np.append(lead, len(s))))
            many = times > 1
            sig = (s[many].astype(np.int64) << 14) ^ np.int64(bucket)
            return pa.record_batch([pa.array(x.astype(np.int64)) for x in (d[many], c[many], least[many], times[many], sig)], names=names)

        for batch in batches:
            for own, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = zstandard.ZstdDecompressor().decompress(blob)
                if n < 0:
                    n = len(raw) // 33
                    known = np.frombuffer(raw, bool, n, 32 * n)
                    columns = [np.frombuffer(raw, np.int64, n, 8 * n * i) for i in range(4)]
                    yield pa.record_batch([pa.array(columns[0], mask=~known), pa.array(np.full(n, -1)), *map(pa.array, columns[1:])], names=names)
                    continue
                if own != bucket and held:
                    yield shared()
                    held = []
                bucket = own
                held.append((np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.int32, n, 8 * n), np.frombuffer(raw, np.int32, n, 12 * n), np.frombuffer(raw, np.uint32, n, 16 * n)))
        if held:
            yield shared()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "id bigint, kind bigint, least bigint, times bigint, sig bigint")


def postings(met: DataFrame, copies: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, sigs): the segments by which a document can meet all that link with it.

    A segment that one document has goes no further. Of its q shared segments in a class a document keeps the
    q - least + 1 that fewest documents have: of the `least` or more that two linked documents share, the
    one of fewest documents is then kept by both (the prefix filter, with segments for tokens). So
    common passages, whose segments many documents have, do not bring their documents together.
    copies (a, b) has for ids with one set the least id that has the same: it stands for all.
    """
    by_doc = met.groupBy("id", "kind").agg(F.min("least").alias("least"), F.array_sort(F.collect_list(F.struct("times", "sig"))).alias("x"))
    by_doc = by_doc.where(F.size("x") >= F.col("least")).select("id", F.slice("x.sig", F.lit(1), (F.size("x") - F.col("least") + 1).cast("int")).alias("sigs"))
    by_doc = by_doc.join(small_or_shuffled(copies.select(F.col("a").alias("id"), "b"), broadcast_rows), "id", "left").select(F.coalesce("b", "id").alias("id"), "sigs")
    return by_doc.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("sigs"))).alias("sigs"))


class Path:
    """A pivot's walk over the prefix tree of other sets, which come in lexicographic order as the tree's paths.

    A path reuses the overlaps counted along the part it shares with the one before; it ends where the
    overlap so far and the shorter remainder cannot reach what the sizes ask, and a next path that
    shares this part is cut there too. `counted` and `reused` are the shingles looked up and those shared.
    """

    def __init__(self, pivot: np.ndarray, percent: int):
        self.pivot, self.percent, self.counted, self.reused = pivot, percent, 0, 0
        self.last, self.hits, self.spots = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def links(self, own: np.ndarray) -> bool:
        pivot, both = self.pivot, min(len(own), len(self.last), len(self.hits) - 1)
        differ = np.flatnonzero(own[:both] != self.last[:both])
        depth = int(differ[0]) if len(differ) else both
        hits, spots, self.last = self.hits[: depth + 1], self.spots[: depth + 1], own
        self.reused += depth
        need = -(-self.percent * (len(pivot) + len(own)) // (100 + self.percent))
        while depth < len(own) and hits[-1] + min(len(own) - depth, len(pivot) - spots[-1]) >= need:
            piece = own[depth : depth + 64]
            at = np.searchsorted(pivot, piece)
            same = pivot[np.minimum(at, len(pivot) - 1)] == piece
            hits = np.concatenate((hits, hits[-1] + np.cumsum(same)))
            spots = np.concatenate((spots, at + same))
            depth += len(piece)
            self.counted += len(piece)
        self.hits, self.spots = hits, spots
        return bool(depth == len(own) and hits[-1] >= need)


def linked(pivot: np.ndarray, sets: list[np.ndarray], percent: int) -> list[bool]:
    """Which sets link with pivot, by one walk over the prefix tree of the sets."""
    path, out = Path(pivot, percent), [False] * len(sets)
    for i in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()):
        out[i] = path.links(sets[i])
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int, at_once: int = 256, broadcast_rows: int = 200_000) -> DataFrame:
    """(a, b) for those pairs of ids (a, b) whose sets link; sets has (id, members).

    Partners of a pivot meet it in one task, in the order of the tree of their sets; a pivot of more than
    at_once partners is dealt to as many tasks as that takes, by hash of the partner.
    """
    n = pairs.count()
    dealt = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("id"))
    if n > at_once:
        hot = dealt.groupBy("pivot").count().where(F.col("count") > at_once).select("pivot", F.ceil(F.col("count") / at_once).alias("slices"))
        dealt = dealt.join(small_or_shuffled(hot, broadcast_rows, n // at_once), "pivot", "left")
    else:
        dealt = dealt.withColumn("slices", F.lit(1))
    dealt = dealt.select("pivot", "id", F.pmod(F.xxhash64("id", F.lit("slice")), F.coalesce("slices", F.lit(1))).alias("slice"))
    asked = dealt.withColumn("role", F.lit(1)).unionByName(dealt.select("pivot", F.col("pivot").alias("id"), "slice", F.lit(0).alias("role")).distinct())
    rows = sets.select("id", "members").join(small_or_shuffled(asked, broadcast_rows, 2 * n), "id").select("pivot", "slice", "role", "id", "members")

    def walk(batches):
        key, paths = None, []
        for batch in batches:
            out = []
            for pivot, part, role, own, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (pivot, part) != key:
                    key, paths = (pivot, part), []
                members = np.frombuffer(raw, ">u8").astype(np.uint64)
                if role == 0:
                    paths.append(Path(members, percent))
                elif any([p.links(members) for p in paths]):
                    out.append((pivot, own))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    rows = rows.repartition("pivot", "slice")
    if n < 10_000:  # few sets need no more tasks than this, each of which starts Python
        rows = rows.coalesce(max(1, n // 32))
    return rows.sortWithinPartitions("pivot", "slice", "role", "members").mapInArrow(walk, "a bigint, b bigint")


def likely(pairs: DataFrame, sets: DataFrame, percent: int, broadcast_rows: int = 50_000) -> DataFrame:
    """The pairs (a, b, ...) whose sizes and parities allow a link.

    Two sets differ in as many shingles as their parities differ in bits, or more; sets that link
    differ in (s + t)(100 - percent) // (100 + percent) at most.
    """
    n = sets.count()
    for side in "ab":
        own = sets.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.join(small_or_shuffled(own, broadcast_rows, n), side)
    return pairs.where(_may(percent)).drop("size_a", "size_b", "bits_a", "bits_b").distinct()


def _may(percent: int):
    unlike = functools.reduce(operator.add, [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(_PARITY // 64)])
    return F.greatest(unlike, F.abs(F.col("size_a") - F.col("size_b"))) * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)


def classes(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, turns: int = 4) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    Documents link when the intersection of their shingle sets is percent or more of the union;
    component_id is the least id reachable. id_col must be an integer. Copies of a set link without
    comparison, and one stands for all. Then each document is compared with the document it shares most segments with, then with
    the other least documents of its segments unless already connected. Where such pairs
    stay in two components, up to `turns` times with one document by hash of each segment's blocks (while many pairs are left that may link), and lastly, whatever
    these turns have left apart, with every document of another component that shares a segment. So only comparisons whose
    outcome cannot change a component are left out. Texts that are null or without words have an empty set and link with
    nothing; rows that repeat an id count as one document with links of each; a null id links with
    nothing; an empty table gives an empty result; other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        raw = scratch.written(meetings(packed(rows, k, percent, buckets)), "segments")
        sizes = scratch.written(raw.where("kind = -1").select("id", F.col("least").alias("n"), F.col("times").alias("h1"), F.col("sig").alias("h2")), "sizes")
        full = sizes.where("n > 0 and id is not null")
        least = scratch.written(full.groupBy("h1", "h2").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top").drop("top"), "copies")
        keyed, few = full.select("id", "h1", "h2"), least.count() <= broadcast_rows
        shared = keyed.join(F.broadcast(least), ["h1", "h2"]) if few else spread_join(keyed, least, ["h1", "h2"])
        by_id = keyed.withColumn("b", F.lit(None).cast("bigint")).unionByName(shared).groupBy(F.col("id").alias("a"))
        by_id = by_id.agg((F.min(F.struct("h1", "h2")) == F.max(F.struct("h1", "h2"))).alias("one"), F.collect_set("b").alias("b"))
        copies = scratch.written(by_id.select("a", "one", F.explode("b").alias("b")).where("a <> b"), "copies")
        # a copy whose id has no other set is nowhere but here: it takes the component of the least such id in the end
        plain, others = copies.where("one").drop("one"), copies.where("not one").drop("one")
        met = scratch.written(postings(raw.where("kind >= 0"), plain, broadcast_rows), "postings")
        scratch.drop(raw)
        own = met.select("id", F.explode("sigs").alias("sig")).where("id is not null and sig is not null").repartition("sig")
        first = own.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("top")).where("a < top").drop("top")
        pairs = scratch.written(own.join(first, "sig").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n")), "pairs")
        near = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

        def members(batches):
            for batch in batches:
                got = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
                columns = [pa.array([s.astype(">u8").tobytes() for s in got], pa.binary()), pa.array([len(s) for s in got], pa.int64()), pa.array([parity(s) for s in got], pa.list_(pa.int64()))]
                yield pa.record_batch([batch.column(0), *columns], names=["id", "members", "size", "bits"])

        sets = scratch.written(rows.join(small_or_shuffled(near, broadcast_rows), "id").select("id", "text").mapInArrow(members, "id bigint, members binary, size bigint, bits array<bigint>"), "sets")
        open_ = scratch.written(likely(pairs, sets, percent, broadcast_rows // 4), "pairs")
        best = scratch.written(open_.groupBy("b").agg(F.max_by("a", F.struct(F.col("n"), -F.col("a"))).alias("a")).select("a", "b"), "pairs")
        node = components(others.unionByName(scratch.written(verified(best, sets, percent, broadcast_rows=broadcast_rows), "links")), scratch=scratch)

        def compared(pairs, node, tried):
            new = scratch.written(pairs.select("a", "b").join(small_or_shuffled(tried, broadcast_rows), ["a", "b"], "left_anti"), "pairs")
            found = scratch.written(verified(new, sets, percent, broadcast_rows=broadcast_rows), "links")
            return _grown(node, found, scratch), tried.unionByName(new), new.count(), found.isEmpty()

        node, tried, _, _ = compared(_apart(open_, node, broadcast_rows), node, best)
        # the first documents of a segment stay apart where neither links: their other documents may link all the same
        failed, own, last = pairs, None, False
        for turn in range(turns + 1):
            if not last:
                failed = scratch.written(_apart(failed, node, broadcast_rows), "failed")
                own = _open(failed, node, met, sets, scratch, broadcast_rows)
                rows, left = own.agg(F.count("*"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)) / 2).first()
                last = turn == turns or left <= 10 * rows
            if last:
                node, *_ = compared(_more(own, percent), node, tried)
                break
            # a turn shows what share of the pairs may link: where they would be no more than the rows, or none has linked, all are compared next
            node, tried, met_some, fruitless = compared(_centres(own, turn, percent), node, tried)
            last = fruitless or met_some * left <= rows * rows
        moved = plain.join(small_or_shuffled(node.withColumnRenamed("node", "b"), broadcast_rows), "b", "left").select("a", F.coalesce("component", "b").alias("component"))
        node = node.unionByName(moved.withColumnRenamed("a", "node")).withColumnRenamed("node", "id")
        found = sizes.join(small_or_shuffled(node, broadcast_rows), "id", "left")
        return written(found.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id")), "classes")


def _grown(node: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components with more links."""
    if links.isEmpty():
        return node
    return components(node.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), scratch=scratch)


def _apart(pairs: DataFrame, node: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """Pairs whose ends are in different components, with these."""
    got, n = pairs.select("a", "b"), node.count()
    for side in "ab":
        got = got.join(small_or_shuffled(node.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), broadcast_rows, n), side, "left")
    return got.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def _open(failed: DataFrame, node: DataFrame, met: DataFrame, sets: DataFrame, scratch: Scratch, broadcast_rows: int = 200_000) -> DataFrame:
    """(sig, id, component, size, bits, before, n): kept segments that documents of several of the components have that failed pairs keep apart.

    The first document of a segment has been compared with all others of it, so it is left out, and so is the segment unless the others are of two
    components or more: a segment of two documents has nothing left to compare. The first is among the documents seen here, as it
    or another is in a failed pair wherever the segment has two components.
    """
    open_ = scratch.written(failed.select(F.explode(F.array("ca", "cb")).alias("component")).distinct(), "open")
    ids = met.join(small_or_shuffled(node.withColumnRenamed("node", "id"), broadcast_rows), "id", "left").withColumn("component", F.coalesce("component", "id"))
    ids = ids.join(small_or_shuffled(open_, broadcast_rows), "component", "left_semi")
    ordered = let(F.sort_array("sigs"), lambda own: F.transform(own, lambda x, i: F.struct(x.alias("sig"), F.get(own, i - 1).alias("before"))))
    own = scratch.written(ids.select("id", "component", F.inline(ordered)), "open").repartition("sig")
    parts = own.groupBy("sig", "component").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    sigs = parts.groupBy("sig").agg(F.count("*").alias("components"), F.min(F.struct("low", "n")).alias("first"), (F.sum("n") - 1).alias("n"))
    sigs = sigs.where("components > 2 or components = 2 and first.n > 1").select("sig", F.col("first.low").alias("first"), "n")
    rest = own.join(sigs, "sig").where("id <> first").select("sig", "id", "component", "before", "n")
    return scratch.written(rest.join(small_or_shuffled(sets.select("id", "size", "bits"), broadcast_rows // 4), "id"), "open")


def _centres(own: DataFrame, turn: int, percent: int, block: int = 64) -> DataFrame:
    """Pairs across components that may link (see likely), one for a document and segment at most: with the centre of its block.

    The documents of a segment are dealt by hash into blocks of about `block`, anew each turn; the least hash of a block is its centre. So a group of
    documents that link with most of the others grows together from rows in proportion to its postings, and no block is hot.
    """
    draw = F.xxhash64("id", F.lit(turn), F.lit("centre"))
    dealt = own.select("sig", "id", "component", "size", "bits", draw.alias("h"), F.pmod(F.xxhash64("id", F.lit(turn), F.lit("block")), F.ceil(F.col("n") / block)).alias("block"))
    centre = dealt.groupBy("sig", "block").agg(F.min_by(F.struct("id", "component", "size", "bits"), "h").alias("c"))
    centre = centre.select("sig", "block", *[F.col(f"c.{c}").alias(f"{c}_a") for c in ("id", "component", "size", "bits")])
    rows = dealt.select("sig", "block", *[F.col(c).alias(f"{c}_b") for c in ("id", "component", "size", "bits")])
    met = rows.join(centre, ["sig", "block"]).where((F.col("component_a") != F.col("component_b")) & _may(percent))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _more(own: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that keep a segment in common and may link (see likely); own comes from _open.

    A segment says nothing new of two documents that hold the one before it, in order, in common too.
    """
    x, y = (own.select("sig", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "size", "bits", "before")]) for side in "ab")
    new = ~F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False))
    near = x.join(y, "sig").where((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & new & _may(percent))
    return near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
