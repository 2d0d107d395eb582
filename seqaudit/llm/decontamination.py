"""Benchmark decontamination by SimHash windows, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_or_shuffled, written

BLOCKS, BITS = 8, 8


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, k: int) -> Column:
    """Hash of each run of k words, in order; empty if there are fewer words."""
    run = lambda i: F.xxhash64(*[ws[i + j] for j in range(k)])
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(0), F.size(ws) - k), run)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint; a shingle counts as often as it occurs."""
    vote = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", (vote(b) > 0).cast("bigint"), b)))


def block(fingerprint: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", fingerprint, F.lit(n) * BITS if isinstance(n, int) else n * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Shared weight over joint weight of two shingle lists, a shingle weighing as often as it occurs.

    Lists without repeats, which most are, are compared as sets.
    """
    times = lambda x, own: F.size(F.filter(own, lambda y: y == x))
    total = lambda pick: F.aggregate(F.array_union(a, b), F.lit(0), lambda s, x: s + pick(times(x, a), times(x, b)))
    once = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    shared = F.size(F.array_intersect(a, b))
    return F.when(once(a) & once(b), shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))).otherwise(total(F.least) / F.greatest(total(F.greatest), F.lit(1)))


def starts(at: Column, window: Column, last: Column, need: Column) -> Column:
    """Every start up to last whose window holds need or more of the sorted positions, in order.

    The window at s holds them if the need-th of the positions from s on lies in it. So between two
    positions the starts are one run, and the work is the positions and the starts found.
    """
    low = lambda p, i: F.greatest(F.when(i > 0, F.get(at, i - 1) + 1).otherwise(F.lit(0)), F.get(at, i + need - 1) - window + 1)
    run = lambda p, i: F.when((i + need <= F.size(at)) & (low(p, i) <= F.least(p, last)), F.sequence(low(p, i), F.least(p, last))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(at, run))


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """(id_col, item_col, similarity) for every document with a window as long as an item, in words,
    whose weighted k-word shingles have the similarity or more; the best window counts.

    A window of a shingles reaches the similarity t with an item of b only if t * (a + b) / (1 + t)
    or more of its positions have a shingle of the item. So, for each length of items, every start is
    laid whose window has that many shingles of items of the length, whatever their order and
    distance (a shorter document is one window). Each window's SimHash is looked up in a
    multi-index: items list, for each of 8 blocks, all values within radius // 8 bits, so that
    every item of that length within the radius is met; the exact similarity then decides.

    Items shorter than k words are one shingle of all their words. Items and documents without words
    leak nothing; null texts count as empty; rows that repeat an id count together; a null id is
    reported as null; other columns are not read. The item tables are broadcast only up to
    broadcast_rows rows, else both sides are shuffled.
    """
    own = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0).select("item", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(k)).alias("k"))
    found = [_leaks_of(docs, own.where(F.col("k") == j), j, threshold, radius, id_col, text_col, broadcast_rows) for j in sorted(r["k"] for r in own.select("k").distinct().collect())]
    if not found:
        return docs.select(F.col(id_col), F.lit(None).cast(items.schema[item_col].dataType).alias(item_col), F.lit(0.0).alias("similarity")).where(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("id", "item").agg(F.max("similarity").alias("similarity")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity")


def _leaks_of(docs, own, k, threshold, radius, id_col, text_col, broadcast_rows):
    own = written(own.select("item", "n", shingles(F.col("w"), k).alias("h")).withColumn("print", simhash(F.col("h"))), "items")
    spots = small_or_shuffled(own.select("n", F.explode("h").alias("hash")).distinct(), broadcast_rows)
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    met = texts.select("id", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "hash")).join(spots, "hash")
    met = met.groupBy("id", "size", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # all lengths in shingles; the small number lets a window through that meets the threshold but for rounding
    met = met.withColumn("item", F.col("n") - k + 1).withColumn("window", F.least("item", F.col("size") - k + 1)).withColumn("last", F.col("size") - k + 1 - F.col("window"))
    met = met.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("item") + F.col("window")) * F.lit(threshold / (1 + threshold)) - 1e-6).cast("int")))
    laid = met.where(F.size("at") >= F.col("need")).select("id", "size", "n", starts(F.col("at"), F.col("window"), F.col("last"), F.col("need")).alias("starts"))
    laid = written(laid.where(F.size("starts") > 0), "windows")
    by_doc = laid.groupBy(F.struct("id", "size").alias("key")).agg(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct("n", s.alias("start"))))).alias("windows"))
    rows = texts.select(F.struct("id", F.size("w").alias("size")).alias("key"), "w").join(by_doc, "key")
    rows = rows.select("key.id", shingles(F.col("w"), k).alias("h"), "windows").select("id", F.explode(F.transform("windows", lambda x: F.struct(x["n"].alias("n"), F.slice("h", x["start"] + 1, x["n"] - k + 1).alias("h")))).alias("x"))
    seen = rows.select("id", "x.n", "x.h").where(F.size("h") > 0).select("id", "n", "h", simhash(F.col("h")).alias("print"))
    numbers = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    seen = seen.select("*", F.explode(F.transform(numbers, lambda b: F.struct(b.alias("block"), block(F.col("print"), b).alias("value")))).alias("x")).select("id", "n", "h", "print", "x.block", "x.value")
    flips = [sum(1 << i for i in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(BITS), r)]
    masks = F.array(*[F.lit(m) for m in flips])
    index = own.select("item", "n", F.col("h").alias("item_h"), F.col("print").alias("item_print"), F.explode(F.flatten(F.transform(numbers, lambda b: F.transform(masks, lambda m: F.struct(b.alias("block"), block(F.col("print"), b).bitwiseXOR(m).alias("value")))))).alias("x")).select("item", "n", "item_h", "item_print", "x.block", "x.value")
    near = seen.join(small_or_shuffled(index, broadcast_rows), ["n", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("id", "item", "h", "item_h").distinct().select("id", "item", similarity(F.col("h"), F.col("item_h")).alias("similarity"))
    return near.where(F.col("similarity") >= threshold)
