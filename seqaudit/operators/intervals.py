"""Joins and windows of positions on sequences: merged spans, overlaps, windows, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import draws
from .statistics import run_up


def merge_intervals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Merge spans (s0, s1) of a key that overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("s0", "s1")
    reach = F.max("s1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach >= F.col("s0"), 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1")).drop("_island")


def _level(low: str, high: str) -> Column:
    """The least power of two that the interval [low, high) fits in, as an exponent."""
    return F.ceil(F.log2((F.col(high) - F.col(low)).cast("double"))).cast("int")


def _levels(df: DataFrame, low: str, high: str) -> list[int]:
    """The levels that occur, 64 at most."""
    return sorted(r[0] for r in df.select(_level(low, high)).distinct().collect())


def _laid(df: DataFrame, low: str, high: str, others: list[int]) -> DataFrame:
    """df once for each (_level, _bin) that an interval touches: bins of 2 ** _level positions, at its own level (_own), where it touches two
    at most, and at each higher one of `others`."""
    above = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("_fit"))
    every = F.concat(F.array(F.struct(F.col("_fit").alias("_level"), F.lit(True).alias("_own"))), F.transform(above, lambda x: F.struct(x.alias("_level"), F.lit(False).alias("_own"))))
    rows = df.withColumn("_fit", _level(low, high))
    rows = rows.select(*df.columns, F.inline(every))
    size = F.pow(F.lit(2.0), F.col("_level"))
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))))


def interval_overlap(queries: DataFrame, spans: DataFrame, key: str = "accession", cls: str = "cls") -> DataFrame:
    """Covered length and share of each query [w0, w1) by each class that meets it, spans merged first.

    The join is on (key, level, bin): bins of powers of two, by the lengths that occur, so that a long genome is spread over tasks and no
    caller chooses a size. A pair meets at the higher of both levels and counts in the bin where its overlap begins. Repeated
    queries give the same row once each; empty queries and those that no span meets give none.
    """
    merged = merge_intervals(spans.where("s1 > s0"), [key, cls])
    own = queries.where("w1 > w0").groupBy(*queries.columns).agg(F.count("*").alias("_times"))
    x = _laid(own, "w0", "w1", _levels(merged, "s0", "s1"))
    y = _laid(merged, "s0", "s1", _levels(own, "w0", "w1")).select(F.col(key).alias("_key"), cls, "s0", "s1", F.col("_level").alias("_level_s"), F.col("_bin").alias("_bin_s"), F.col("_own").alias("_own_s"))
    same = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_level_s")) & (F.col("_bin") == F.col("_bin_s"))
    met = x.join(y, same & (F.col("s0") < F.col("w1")) & (F.col("s1") > F.col("w0")) & (F.col("_own") | F.col("_own_s")))
    met = met.where(F.floor(F.greatest("s0", "w0") / F.pow(F.lit(2.0), F.col("_level"))) == F.col("_bin"))
    got = met.groupBy(*queries.columns, "_times", cls).agg(F.sum(F.least("w1", "s1") - F.greatest("w0", "s0")).alias("covered"))
    got = got.withColumn("frac", F.col("covered") / (F.col("w1") - F.col("w0")))
    return got.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).drop("_times", "_copy")


def point_in_interval(points: DataFrame, spans: DataFrame, key: str = "accession", cls: str = "cls") -> DataFrame:
    """Points with each class that has a span over their pos; joined on (key, level, bin) as in interval_overlap."""
    merged = merge_intervals(spans.where("s1 > s0"), [key, cls])
    levels = _levels(merged, "s0", "s1")
    laid = _laid(merged, "s0", "s1", []).select(F.col(key).alias("_key"), cls, "s0", "s1", F.col("_level").alias("_level_s"), F.col("_bin").alias("_bin_s"))
    at = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", F.floor(F.col("pos") / F.pow(F.lit(2.0), F.col("_level"))))
    same = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_level_s")) & (F.col("_bin") == F.col("_bin_s"))
    return at.join(laid, same & (F.col("pos") >= F.col("s0")) & (F.col("pos") < F.col("s1"))).select(*points.columns, cls)


def winning_class(queries: DataFrame, spans: DataFrame, key: str = "accession", cls: str = "cls") -> DataFrame:
    """Queries with the class that covers most of each, the first by name on ties; null where none does."""
    best = interval_overlap(queries.select(key, "w0", "w1").distinct(), spans, key, cls).groupBy(key, "w0", "w1").agg(F.min_by(cls, F.struct(-F.col("covered"), F.col(cls))).alias(cls))
    return queries.join(best, [key, "w0", "w1"], "left")


def region_lengths(genomes: DataFrame, spans: DataFrame, key: str = "accession", cls: str = "cls") -> DataFrame:
    """Covered length and share of each class; `any` is their union and `other` the rest."""
    union = merge_intervals(spans.select(key, "s0", "s1"), [key]).withColumn(cls, F.lit("any"))
    each = merge_intervals(spans, [key, cls]).unionByName(union).groupBy(key, cls).agg(F.sum(F.col("s1") - F.col("s0")).alias("len"))
    got = genomes.join(each, key).select(key, "n", cls, "len")
    rest = genomes.join(each.where(F.col(cls) == "any"), key, "left").select(key, "n", F.lit("other").alias(cls), (F.col("n") - F.coalesce("len", F.lit(0))).alias("len"))
    return got.unionByName(rest).withColumn("frac", F.col("len") / F.col("n"))


def complement(genomes: DataFrame, spans: DataFrame, key: str = "accession") -> DataFrame:
    """The stretches [s0, s1) of each genome that no span covers."""
    ends = genomes.select(key, F.col("n").alias("s0"), F.col("n").alias("s1")).unionByName(genomes.select(key, F.lit(0).alias("s0"), F.lit(0).alias("s1")))
    merged = merge_intervals(spans.select(key, "s0", "s1").unionByName(ends.select(key, F.col("s0").cast("int"), F.col("s1").cast("int"))), [key])
    after = F.lead("s0").over(Window.partitionBy(key).orderBy("s0"))
    return merged.select(key, F.col("s1").alias("s0"), after.alias("s1")).where("s1 > s0")


def mass_enrichment(track: DataFrame, spans: DataFrame, key: str = "accession", cls: str = "cls") -> DataFrame:
    """Share of the absolute score that lies in a class over the share of its length."""
    total = track.groupBy(key).agg(F.sum(F.abs("attr")).alias("total"), F.count("*").alias("n"))
    inside = point_in_interval(track, spans, key, cls).groupBy(key, cls).agg(F.sum(F.abs("attr")).alias("mass"), F.count("*").alias("len"))
    return inside.join(total, key).select(key, cls, (F.col("mass") / F.nullif(F.col("total"), F.lit(0.0)) / (F.col("len") / F.col("n"))).alias("enrichment"))


def equal_windows(genomes: DataFrame, w: int, key: str = "accession") -> DataFrame:
    """Split [0, n) in w windows with edges floor(i n / w)."""
    got = genomes.select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("window_index"))
    edge = lambda i: F.floor(i * F.col("n") / w).cast("int")
    return got.select(key, "window_index", edge(F.col("window_index")).alias("w0"), edge(F.col("window_index") + 1).alias("w1"))


def window_scores(track: DataFrame, windows: DataFrame, key: str = "accession") -> DataFrame:
    """Mean absolute score of each window over its length, positions without a row counting 0.

    Edges and positions are run through once in order, which gives the sum before each edge; so a track may have gaps.
    A genome without a track has no row.
    """
    edges = windows.select(key, F.explode(F.array("w0", "w1")).alias("pos")).distinct().select(key, "pos", F.lit(0).alias("_kind"), F.lit(0.0).alias("_x"))
    both = edges.unionByName(track.select(key, "pos", F.lit(1).alias("_kind"), F.abs("attr").alias("_x")))
    run = Window.partitionBy(key).orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = both.withColumn("_cum", F.sum("_x").over(run)).where("_kind = 0")
    hi, lo = sums.select(key, F.col("pos").alias("w1"), F.col("_cum").alias("_hi")), sums.select(key, F.col("pos").alias("w0"), F.col("_cum").alias("_lo"))
    got = windows.join(track.select(key).distinct(), key, "left_semi").join(hi, [key, "w1"]).join(lo, [key, "w0"])
    return got.select(key, "window_index", "w0", "w1", ((F.col("_hi") - F.col("_lo")) / F.nullif(F.col("w1") - F.col("w0"), F.lit(0))).alias("score"))


def rank_windows(windows: DataFrame, score: str = "score", key: str = "accession") -> DataFrame:
    """rank from 1 by score (ties: window_index), is_top, and is_high: the first max(1, n div 2)."""
    order = Window.partitionBy(key).orderBy(F.desc(score), "window_index")
    got = windows.withColumn("rank", F.row_number().over(order))
    half = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(key)) / 2))
    return got.withColumn("is_top", F.col("rank") == 1).withColumn("is_high", F.col("rank") <= half)


def top_quantile(track: DataFrame, q: float, key: str = "accession") -> DataFrame:
    """Flag the top ceil(q n) positions, one at least, by absolute score."""
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("attr")), "pos")
    n = F.count("*").over(Window.partitionBy(key))
    return track.withColumn("is_top", F.row_number().over(order) <= F.greatest(F.lit(1), F.ceil(n * q)))


def top_positions(track: DataFrame, n: int = 3, key: str = "accession") -> DataFrame:
    """The n highest positions of each key with their rank, the earlier first on ties."""
    order = Window.partitionBy(key).orderBy(F.desc("attr"), "pos")
    return track.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def peak_fragment(track: DataFrame, windows: DataFrame, frag_len: int = 250, key: str = "accession") -> DataFrame:
    """The fragment of frag_len with the highest absolute score in each window, the earliest on ties."""
    inside = track.join(windows, key).where("pos >= w0 and pos < w1")
    ahead = Window.partitionBy(key, "window_index").orderBy("pos").rowsBetween(0, frag_len - 1)
    full = inside.withColumn("frag", F.sum(F.abs("attr")).over(ahead)).where(F.col("pos") + frag_len <= F.col("w1"))
    order = Window.partitionBy(key, "window_index").orderBy(F.desc(F.round("frag", 6)), "pos")
    return full.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(key, "window_index", F.col("pos").alias("frag_start"), "frag")


def sliding_starts(seqs: DataFrame, length: str, window_len: int, stride: int | None = None, overlap: float = 0.1) -> DataFrame:
    """Window starts over each length: stride steps, and a last start at length - window_len.

    Without a stride it follows from the share that neighbours overlap, which is held within 0.1 and 0.5.
    """
    stride = stride or max(1, round(window_len * (1 - min(max(overlap, 0.1), 0.5))))
    last = F.greatest(F.col(length) - window_len, F.lit(0))
    steps = F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(stride))
    starts = steps if stride >= window_len else F.array_union(steps, F.array(last.cast("int")))
    return seqs.withColumn("start", F.explode(starts))


def prefix_sums(track: DataFrame, edges: DataFrame, key: str = "accession") -> DataFrame:
    """(key, edge, cum): the absolute score before each edge. Edges and positions run up together, so a track may have gaps and a long one is cut in ranges."""
    both = track.select(key, "pos", F.abs("attr").alias("_x"), F.lit(False).alias("_e")).unionByName(edges.select(key, F.col("edge").alias("pos"), F.lit(0.0).alias("_x"), F.lit(True).alias("_e")))
    sums = run_up(both.groupBy(key, "pos").agg(F.sum("_x").alias("_x"), F.max("_e").alias("_e")), [key], "pos", ["_x"])
    return sums.where("_e").select(key, F.col("pos").alias("edge"), F.col("_x_under").alias("cum"))


def track_lengths(track: DataFrame, key: str = "accession") -> DataFrame:
    """(key, n): positions up to the last that has a row."""
    return track.groupBy(key).agg((F.max("pos") + 1).cast("bigint").alias("n"))


def circular_mass(track: DataFrame, spots: DataFrame, key: str = "accession") -> DataFrame:
    """spots with mass: the absolute score of [a, a + len) on a circle of n positions; spots has key, a, len, n, a < n and len <= n."""
    end = F.col("a") + F.col("len")
    own = spots.withColumn("_z", F.least(end, "n")).withColumn("_over", F.greatest(end - F.col("n"), F.lit(0)))
    edges = own.select(key, F.explode(F.array(F.col("a").cast("bigint"), F.col("_z").cast("bigint"), F.col("_over").cast("bigint"))).alias("edge")).distinct()
    sums = prefix_sums(track, edges, key)
    for at, name in (("a", "_lo"), ("_z", "_hi"), ("_over", "_first")):
        own = own.join(sums.select(F.col(key).alias("_key"), F.col("edge").alias("_edge"), F.col("cum").alias(name)), (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_edge"))).drop("_key", "_edge")
    return own.withColumn("mass", F.col("_hi") - F.col("_lo") + F.col("_first")).drop("_z", "_over", "_lo", "_hi", "_first")


def shift_null(track: DataFrame, spans: DataFrame, b: int, key: str = "accession", cls: str = "cls", seed: int = 42, genomes: DataFrame | None = None) -> DataFrame:
    """Circular-shift null of the mass in a class: observed mass, p, null mean and sd of b shifts.

    A genome is one row with its track and merged spans as arrays, which makes its draws and looks its masses up in prefix sums, a place once
    however many shifts fall on it. Shifts are drawn by keyed hashing. A track may have gaps; genomes (key, n) gives lengths, else a genome
    ends with its last position.
    """
    rows = draws.genome_rows(track, merge_intervals(spans.where("s1 > s0"), [key, cls]), genomes or track_lengths(track, key), key, cls)

    def null(scores, times, _):
        mass = draws.sixth(scores)
        mean = float(times @ mass) / b
        return mass[0], (1 + int(times[mass >= mass[0]].sum())) / (1 + b), mean, float(times @ (mass - mean) ** 2 / b) ** 0.5

    return draws.shifted(rows, b, seed, key, cls, null, "observed double, p double, null_mean double, null_sd double")
