"""Ranked lexical search: two trees, of items and of documents, are descended together."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

#: Everything but digits, letters and what is not ASCII separates terms; A-Z become a-z. Both hold for bytes of UTF-8 as for code points.
_FOLD = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))

#: Children of a node in the tree of documents and in that of items.
DOCS, ITEMS = 32, 16


def terms(text: bytes, piece: int = 1 << 20):
    """The terms of a text, a list for each piece of about a megabyte, so that long texts need no more memory."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Tree:
    """Sparse vectors under a hierarchy: the vector of a node has the maximum of each coordinate over its children.

    levels[0] are the vectors; the children of node j of a level are the nodes j * fan to j * fan + fan - 1 of the one below.
    Each level is (offsets, coordinates, values), coordinates ascending within a node.
    """

    def __init__(self, offsets: np.ndarray, coords: np.ndarray, values: np.ndarray, fan: int):
        self.fan, self.levels = fan, [(offsets, coords, values)]
        while len(self.levels[-1][0]) > 2 or len(self.levels) < 2:
            offsets, coords, values = self.levels[-1]
            node = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) // fan
            order = np.lexsort((coords, node))
            node, coords, values = node[order], coords[order], values[order]
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (coords[1:] != coords[:-1])
            at = np.flatnonzero(new)
            n = -(-(len(offsets) - 1) // fan)
            self.levels.append((np.searchsorted(node[at], np.arange(n + 1)), coords[at], np.maximum.reduceat(values, at) if len(at) else values))

    def children(self, level: int, node: int) -> tuple[int, int]:
        return node * self.fan, min(node * self.fan + self.fan, len(self.levels[level - 1][0]) - 1)

    def dense(self, level: int, low: int, high: int, coords: np.ndarray, dtype) -> np.ndarray:
        """Nodes low to high - 1 of a level as rows, over the given ascending coordinates."""
        offsets, own, values = self.levels[level]
        own, values = own[offsets[low] : offsets[high]], values[offsets[low] : offsets[high]]
        row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        out = np.zeros((high - low, len(coords)), dtype)
        if len(coords):
            at = np.searchsorted(coords, own)
            at[at == len(coords)] = 0
            hit = coords[at] == own
            out[row[hit], at[hit]] = values[hit]
        return out


class Best:
    """The k best (score, id) of each item so far; equal scores by ascending id. Unfilled places have score 0."""

    def __init__(self, items: int, k: int, dtype):
        self.k, self.scores, self.ids = k, np.zeros((items, k), dtype), np.full((items, k), np.iinfo(np.int64).max)

    def least(self, low: int, high: int):
        return self.scores[low:high, -1].min()

    def add(self, low: int, high: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of documents (rows) for the items low to high - 1 (columns)."""
        kth, kth_id = self.scores[low:high, -1], self.ids[low:high, -1]
        better = (scores > kth) | ((scores == kth) & (ids[:, None] < kth_id) & (scores > 0))
        for i in np.flatnonzero(better.any(axis=0)):
            s, d = np.append(self.scores[low + i], scores[better[:, i], i]), np.append(self.ids[low + i], ids[better[:, i]])
            order = np.lexsort((d, -s))[: self.k]
            self.scores[low + i], self.ids[low + i] = s[order], d[order]


class Items:
    """The tree of items, with the children of each node as a dense matrix over the node's own terms."""

    def __init__(self, offsets, coords, weights, dtype):
        self.tree, self.dtype, self.kept = Tree(offsets, coords, weights, ITEMS), dtype, {}

    def block(self, level: int, node: int, children: bool):
        key = level, node, children
        if key not in self.kept:
            offsets, coords, _ = self.tree.levels[level]
            own = coords[offsets[node] : offsets[node + 1]]
            low, high = self.tree.children(level, node) if children else (node, node + 1)
            self.kept[key] = own, self.tree.dense(level - children, low, high, own, self.dtype).T.copy()
        return self.kept[key]

    def under(self, level: int, node: int) -> tuple[int, int]:
        span = ITEMS**level
        return node * span, min(node * span + span, len(self.tree.levels[0][0]) - 1)


def descend(items: Items, docs: Tree, ids: np.ndarray, best: Best) -> int:
    """Visit pairs of an item node and a document node, the highest bound first; the number of pairs whose documents were scored.

    The bound of a pair is the product of both nodes' maxima. Where it is zero, or less than the weakest kth score of the
    node's items, no document below can enter, and the pair goes with all below it; an equal score may enter by its id, so such pairs stay.
    """
    stack, scored = [(math.inf, len(items.tree.levels) - 1, 0, len(docs.levels) - 1, 0)], 0
    while stack:
        bound, a, i, b, d = stack.pop()
        if bound <= 0 or bound < best.least(*items.under(a, i)):
            continue
        exact = a == b == 1
        down_a, down_b = exact or a > 1, exact or b > 1
        coords, weights = items.block(a, i, down_a)
        low, high = docs.children(b, d) if down_b else (d, d + 1)
        value = docs.dense(b - down_b, low, high, coords, items.dtype) @ weights
        first = items.tree.children(a, i)[0] if down_a else i
        if exact:
            best.add(first, first + value.shape[1], ids[low:high], value)
            scored += 1
        else:
            pairs = [(value[r, c], a - down_a, first + c, b - down_b, low + r) for r, c in zip(*np.nonzero(value), strict=True)]
            stack += sorted(pairs)
    return scored


def _slices(offsets: np.ndarray, most: int):
    """Ranges of rows of at most `most` entries each, or one row."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def _doc_tree(ids: np.ndarray, offsets: np.ndarray, coords: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, Tree]:
    """Documents side by side that have the same strongest term, and each one's terms ascending."""
    row = np.repeat(np.arange(len(ids)), np.diff(offsets))
    order = np.lexsort((coords, -values, row))
    full = np.flatnonzero(np.diff(offsets))
    strongest = np.full(len(ids), -1)
    strongest[full] = coords[order][offsets[full]]
    place = np.empty(len(ids), np.int64)
    by = np.lexsort((ids, strongest))
    place[by] = np.arange(len(ids))
    order = np.lexsort((coords, place[row]))
    return ids[by], Tree(np.append(0, np.cumsum(np.diff(offsets)[by])), coords[order], values[order], DOCS)


def _postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of each row: all its terms counted, those of the vocabulary by number."""

    def read(batches):
        known = vocabulary.value
        for batch in batches:
            ns, sizes, which, tfs = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n, counts = 0, Counter()
                for words in terms(text):
                    n += len(words)
                    counts.update(words)
                found = sorted((known[w], counts[w]) for w in counts.keys() & known.keys())
                ns.append(n)
                which += [t for t, _ in found]
                tfs += [c for _, c in found]
                sizes.append(len(which))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (which, tfs)]
            yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(read, "id bigint, n bigint, terms array<int>, tfs array<int>")


def _best_of_tasks(postings: DataFrame, shared, items: int, k: int) -> DataFrame:
    """(item, id, score, part): the best of each task, which reads its documents in batches and keeps k an item."""

    def search(batches):
        tree, best = Items(*shared.value), None
        best = Best(items, k, tree.dtype)
        for batch in batches:
            ids, m = (batch.column(i).to_numpy() for i in (0, 1))
            start = batch.column(2).offsets.to_numpy()
            for low, high in _slices(start, 1 << 22):
                tfs, coords = (batch.column(i).values.to_numpy()[start[low] : start[high]].astype(np.int64) for i in (3, 2))
                value = 1_000_000_000 * tfs // (1000 * tfs + 20 * np.repeat(m[low:high], np.diff(start[low : high + 1])))
                own, docs = _doc_tree(ids[low:high], start[low : high + 1] - start[low], coords, value)
                descend(tree, docs, own, best)
        item, place = np.nonzero(best.scores)
        part = np.full(len(item), TaskContext.get().partitionId(), np.int32)
        yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(best.ids[item, place]), pa.array(best.scores[item, place].astype(np.int64)), pa.array(part)], names=["item", "id", "score", "part"])

    return postings.mapInArrow(search, "item int, id bigint, score bigint, part int")


def rank(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = 250_000) -> DataFrame:
    """(item, rank, id, score): the k highest-scoring rows of docs for each item, all if fewer score above 0; equal scores by ascending id.

    Items are searched in blocks of about block_terms terms, as the tree of a block and its terms are broadcast; docs are read
    once a block. A task keeps k rows an item, these meet by item and group of tasks and then by item. All texts count
    towards the statistics. Rows without an id count there and are not returned; rows that repeat an id are
    documents of their own; ids are whole numbers. Texts that share an item id are one item; a null item id is an id. Null or empty texts have no
    terms; an item without terms, or none that a document holds, has no row; empty tables give an empty result.
    """
    spark, out = docs.sparkSession, []
    with Scratch(spark) as scratch:
        def split(batches):
            for batch in batches:
                each = [sorted({w for words in terms(t) for w in words}) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                at = np.repeat(np.arange(len(each)), [len(x) for x in each])
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array([w for x in each for w in x], pa.binary())], names=["item", "term"])

        kind = queries.select(F.col(item_col).alias("item")).schema["item"].dataType
        texts = queries.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
        asked = scratch.written(texts.mapInArrow(split, f"item {kind.simpleString()}, term binary").distinct(), "item-terms")
        blocks = max(1, -(-asked.count() // block_terms))
        for block in range(blocks):
            pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
            if not pairs:
                continue
            words = sorted({bytes(p["term"]) for p in pairs})
            number = {w: i for i, w in enumerate(words)}
            own: dict = {}
            for p in pairs:
                own.setdefault(p["item"], []).append(number[bytes(p["term"])])
            names = sorted(own, key=lambda x: sorted(own[x]))  # items with the same first terms side by side
            postings = scratch.written(_postings(docs, spark.sparkContext.broadcast(number), id_col, text_col), "postings")
            n, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            if not total:
                continue
            df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
            weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(words))])
            vectors = [np.sort(own[x]) for x in names]
            offsets, coords = np.append(0, np.cumsum([len(v) for v in vectors])), np.concatenate(vectors)
            dtype = np.float64 if max(int(weight[v].sum()) for v in vectors) < 2**53 // 1_000_000 else np.int64  # doubles add these whole numbers exactly
            shared = spark.sparkContext.broadcast((offsets, coords, weight[coords], dtype))
            m = (F.lit(50) + F.expr(f"cast((50 * n * cast({n} as decimal(20, 0))) div cast({total} as decimal(20, 0)) as bigint)")).alias("m")
            tops = _best_of_tasks(postings.where("id is not null and size(terms) > 0").select("id", m, "terms", "tfs"), shared, len(names), k)
            order = [F.desc("score"), "id"]
            for by in (["item", F.pmod("part", F.lit(64))], ["item"]):
                tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
            named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, name {kind.simpleString()}")
            got = tops.join(F.broadcast(named), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
            out.append(written(got, "ranked"))
    if not out:
        return spark.createDataFrame([], f"{item_col} {kind.simpleString()}, rank int, {id_col} bigint, score bigint")
    got = out[0]
    for more in out[1:]:
        got = got.unionByName(more)
    return got
