"""Keyed draws of nulls inside tasks: the row of a genome or fragment brings its track and spans as arrays and makes all its draws in numpy, so no draw is a row of Spark's.

A genome's track is held by one task at a time, with 16 bytes a position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import draw_grid


def dealt(df: DataFrame, *cols) -> DataFrame:
    """df over all shuffle partitions by the columns: few small rows make much work here, so Spark must not gather them in a few tasks.

    They go by a hash of the columns, as Spark leaves out a shuffle by columns that a join has dealt by, and merges the join's small partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*cols, F.lit("dealt")))


def genome_rows(track: DataFrame, spans: DataFrame, size: DataFrame, key: str, cls: str) -> DataFrame:
    """(key, text, n, track, spans): of each genome with spans its length, its rows (pos, x) with the absolute score, and its spans (cls, s0, len)."""
    rows = track.groupBy(key).agg(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), F.abs(F.coalesce("attr", F.lit(0.0))).cast("double").alias("x"))).alias("track"))
    own = spans.groupBy(key).agg(F.collect_list(F.struct(F.col(cls).alias("cls"), F.col("s0").cast("bigint").alias("s0"), F.greatest(F.col("s1") - F.col("s0"), F.lit(0)).cast("bigint").alias("len"))).alias("spans"))
    return dealt(size.join(own, key).join(rows, key).select(key, F.col(key).cast("string").alias("text"), F.col("n").cast("bigint").alias("n"), "track", "spans"), key)


def pieces(batch: pa.RecordBatch, name: str) -> list[dict[str, np.ndarray]]:
    """The structs of each row's list as an array a field."""
    column = batch.column(name)
    flat, cuts = column.flatten(), np.cumsum(column.value_lengths().to_numpy())[:-1]
    names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
    parts = [np.split(flat.field(i).to_numpy(zero_copy_only=False), cuts) for i in range(len(names))]
    return [dict(zip(names, row, strict=True)) for row in zip(*parts, strict=True)]


def keyed_rows(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """What follows the last drawn number in a key's text: a bar and the key, nothing for a null."""
    return ["" if t is None else f"|{t}" for t in batch.column(name).to_pylist()]


class Circle:
    """Sums of a genome's score over stretches of a circle of n positions; positions without a row count 0."""

    def __init__(self, track: dict[str, np.ndarray], n: int):
        order = np.argsort(track["pos"], kind="stable")
        self.pos, self.cum, self.n = track["pos"][order], np.append(0.0, np.cumsum(track["x"][order])), n

    def under(self, edge: np.ndarray) -> np.ndarray:
        return self.cum[np.searchsorted(self.pos, edge)]

    def mass(self, a: np.ndarray, length: int) -> np.ndarray:
        """The score of [a, a + length), a < n and length <= n."""
        end = a + length
        return self.under(np.minimum(end, self.n)) - self.under(a) + self.under(np.maximum(end - self.n, 0))

    def classes(self, spans: dict[str, np.ndarray], moves: np.ndarray):
        """Each class of the spans with its score at every move of them along the circle."""
        for name in sorted(set(spans["cls"]), key=str):
            own = [i for i, c in enumerate(spans["cls"]) if c == name]
            yield name, sum((self.mass((spans["s0"][i] + moves) % self.n, int(spans["len"][i])) for i in own if spans["len"][i]), np.zeros(len(moves)))


def sixth(x: np.ndarray) -> np.ndarray:
    """Numbers of 0 or more to six digits, halves up."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def shifted(rows: DataFrame, b: int, seed: int, key: str, cls: str, use, fields: str, back: bool = False) -> DataFrame:
    """(key, cls, fields): use(scores at the moves, times, number of track rows) of each class of each genome, over 0 and the distinct ones of b
    keyed moves; 0 is the first. The spans move, or with back=True the track does."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        inner = [str(i) for i in range(1, b + 1)]
        for batch in batches:
            if not batch.num_rows:
                continue
            n, texts, tracks, spans = batch.column("n").to_numpy(), keyed_rows(batch), pieces(batch, "track"), pieces(batch, "spans")
            at, got = [], []
            for low in range(0, len(n), 64):
                some = texts[low : low + 64]
                for i, drawn in enumerate(draw_grid([f"{seed}|"] * len(some), inner, some) % n[low : low + 64, None], low):
                    moves, times = np.unique(np.append(drawn, 0), return_counts=True)
                    times[0] -= 1
                    for name, scores in Circle(tracks[i], int(n[i])).classes(spans[i], -moves if back else moves):
                        at.append(i)
                        got.append((name, *use(scores, times, len(tracks[i]["pos"]))))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*got), [rows_cls, *[pa.float64()] * len(names)])]
            yield pa.record_batch([batch.column(key).take(pa.array(at)), *columns], names=[key, cls, *names])

    kind = rows.schema["spans"].dataType.elementType["cls"].dataType.simpleString()
    rows_cls = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{cls}` {kind}, {fields}")


def summed(parts: DataFrame, cls: str) -> DataFrame:
    """(cls, perm, one column for each array): arrays by permutation that tasks have counted, added up."""
    arrays = [c for c in parts.columns if c != cls]
    long = parts.select(cls, F.posexplode(F.arrays_zip(*arrays)).alias("perm", "v")).select(cls, "perm", *[F.col(f"v.{c}").alias(c) for c in arrays])
    return long.groupBy(cls, "perm").agg(*[F.sum(c).alias(c) for c in arrays])


def placed_hits(fragments: DataFrame, b: int, length: int, share: float, seed: int) -> DataFrame:
    """(cls, perm, h): how many fragments lie in a class with `share` of their length, perm 0 where they are and 1..b at keyed random starts.

    fragments has (accession, frag_id, frag_start, n, spans), spans the merged ones (cls, s0, len) of its genome.
    """

    def run(batches):
        inner, hits = [str(i) for i in range(1, b + 1)], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            n, own, after, spans = batch.column("n").to_numpy(), batch.column("frag_start").to_numpy(), keyed_rows(batch), pieces(batch, "spans")
            for low in range(0, len(n), 64):
                some = after[low : low + 64]
                for i, drawn in enumerate(draw_grid([f"{seed}|"] * len(some), inner, some) % (n[low : low + 64, None] - length + 1), low):
                    w0 = np.append(own[i], drawn)
                    order = np.argsort(spans[i]["s0"], kind="stable")
                    for name in set(spans[i]["cls"]):
                        at = [j for j in order if spans[i]["cls"][j] == name]
                        s0, run_len = spans[i]["s0"][at], spans[i]["len"][at]
                        total, ends = np.append(0, np.cumsum(run_len)), np.append(0, s0 + run_len)

                        def covered(x):
                            k = np.searchsorted(s0, x)  # noqa: B023
                            return total[k] - np.maximum(np.where(k > 0, ends[k] - x, 0), 0)  # noqa: B023

                        inside = (covered(w0 + length) - covered(w0)) / length >= share
                        hits[name] = hits.get(name, 0) + inside.astype(np.int64)
        if hits:
            yield pa.record_batch([pa.array(list(hits)), pa.array(list(hits.values()), pa.list_(pa.int64()))], names=["cls", "h"])

    return summed(fragments.mapInArrow(run, "cls string, h array<bigint>"), "cls")


def top_windows(genomes: DataFrame, b: int, seed: int) -> DataFrame:
    """(cls, perm, a, high, inside, every): of the windows that are top, as given (perm 0) or drawn (1..b), the rows of a class inside it and all;
    in perm 0 also these counts of all windows.

    genomes has (text, windows), windows the rows (window_index, top, cls, inside) of a genome.
    """

    def run(batches):
        inner, counts = [str(i) for i in range(1, b + 1)], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            after, windows = keyed_rows(batch), pieces(batch, "windows")
            for low in range(0, len(after), 64):
                some = after[low : low + 64]
                for w, drawn in zip(windows[low : low + 64], draw_grid([f"{seed}|"] * len(some), inner, some), strict=True):
                    index = w["window_index"]
                    k = len(np.unique(index))
                    at, tops, wide = drawn % k, np.unique(index[w["top"].astype(bool)]), max(k, int(index.max()) + 1)
                    for name in set(w["cls"]):
                        own = w["cls"] == name
                        both = [np.bincount(index[own], weights, wide).astype(np.int64) for weights in (w["inside"][own], None)]
                        if name not in counts:
                            counts[name] = np.zeros((4, b + 1), np.int64)
                        for row, table in enumerate(both):
                            counts[name][row] += np.append(table[tops].sum(), table[at])
                            counts[name][2 + row, 0] += table.sum()
        if counts:
            yield pa.record_batch([pa.array(list(counts)), *[pa.array([list(v[i]) for v in counts.values()], pa.list_(pa.int64())) for i in range(4)]], names=["cls", "a", "high", "inside", "every"])

    return summed(genomes.mapInArrow(run, "cls string, a array<bigint>, high array<bigint>, inside array<bigint>, every array<bigint>"), "cls")


def locus_z(rows: DataFrame, b_outer: int, b_inner: int, seed: int) -> DataFrame:
    """(outer, n, z): over genomes, the number and sum of z of a locus against b_inner shifts; outer 0 is the locus itself, the others start at random."""

    def run(batches):
        outers, inner, total, number = [str(o) for o in range(b_outer + 1)], [str(i) for i in range(1, b_inner + 1)], np.zeros(b_outer + 1), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, after, tracks, spans = batch.column("n").to_numpy(), keyed_rows(batch), pieces(batch, "track"), pieces(batch, "spans")
            for low in range(0, len(after), 4):  # a few genomes are drawn at once, as their texts are much alike
                some = after[low : low + 4]
                starts = draw_grid([f"{seed}|locus|"] * len(some), outers[1:], some)
                moves = draw_grid([f"{seed}|shift|{o}|" for _ in some for o in outers], inner, [t for t in some for _ in outers], dtype=np.uint32).reshape(len(some), len(outers), -1)
                for i, (drawn, moved) in enumerate(zip(starts, moves, strict=True), low):
                    n, circle, length = int(lengths[i]), Circle(tracks[i], int(lengths[i])), int(spans[i]["len"][0])
                    start = np.append(spans[i]["s0"][0], drawn % (n - length)) % n
                    moved -= moved // np.uint32(n) * np.uint32(n)
                    at = moved + start[:, None]
                    if n <= b_outer * b_inner:
                        whole = np.tile(sixth(circle.mass(np.arange(n), length)), 2)
                        seen, null = whole[start], whole.take(at)
                    else:
                        seen, null = sixth(circle.mass(start, length)), sixth(circle.mass(at % n, length))
                    mean = null.sum(axis=1) / b_inner
                    sd = np.sqrt(np.maximum(np.einsum("oi,oi->o", null, null) / b_inner - mean * mean, 0))
                    total += (seen - mean) / (sd + 1e-6)
                    number += 1
        if number:
            yield pa.record_batch([pa.array(range(b_outer + 1), pa.int32()), pa.array([number] * (b_outer + 1), pa.int64()), pa.array(total)], names=["outer", "n", "z"])

    return rows.mapInArrow(run, "outer int, n bigint, z double").groupBy("outer").agg(F.sum("n").alias("n"), F.sum("z").alias("z"))


def shuffled_places(perms: list[int], n: int, seed: int, own: np.ndarray, rounds: int = 4):
    """For each permutation the places to which it sends the places `own` of 0..n-1, as shuffled_place(own, n, [seed, perm]) does. A round's
    shifts depend on one digit of base sqrt(n) only, so a permutation hashes 4 * sqrt(n) texts."""
    base = max(1, int(np.ceil(np.sqrt(n))))
    digits = [str(r) for r in range(base)]
    for low in range(0, len(perms), 16):
        some = perms[low : low + 16]
        turns = (draw_grid([f"{seed}|{p}|{j}|" for p in some for j in range(rounds)], digits, [""] * (len(some) * rounds)) % base).astype(np.int32)

        def sent(x, tables):
            left, right = np.divmod(x, np.int32(base))
            for table in tables:
                left, right = right, left + table[right]
                right -= np.where(right >= base, np.int32(base), np.int32(0))
            return left * np.int32(base) + right

        for i, p in enumerate(some):
            tables = turns[i * rounds : (i + 1) * rounds]
            x = sent(own, tables)
            while len(over := np.flatnonzero(x >= n)):
                x[over] = sent(x[over], tables)
            yield p, x


def permuted_sums(rows: DataFrame, a: str, b: str, perms: int, seed: int, block: int = 1 << 20) -> DataFrame:
    """(perm, x): the sum of a * b over all rows, b being that of the place a shuffle gives each row; rows have their place in _i, under 2 ** 31.

    Places come in blocks as arrays; a task has one block of a, one of b and some permutations, and adds up the pairs that meet in them. So a
    task's memory is bounded, and up to `block` rows each place is computed once.
    """
    packed = rows.groupBy(F.floor(F.col("_i") / block).alias("at")).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(a).alias("a"), F.col(b).alias("b")))).alias("v"))
    n = rows.agg(F.count("*").alias("n"))
    chunks = min(perms, 64)
    pairs = packed.select("at", F.col("v.a").alias("a")).crossJoin(packed.select(F.col("at").alias("to"), F.col("v.b").alias("b"))).crossJoin(n)
    tasks = dealt(pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(chunks))).alias("chunk")), "at", "to", "chunk")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at, to, n, chunk = (batch.column(c)[i].as_py() for c in ("at", "to", "n", "chunk"))
                x, y = (batch.column(c)[i].values.to_numpy() for c in ("a", "b"))
                own = np.arange(at * block, at * block + len(x), dtype=np.int32)
                got = []
                for perm, place in shuffled_places(list(range(chunk, perms + 1, chunks)), n, seed, own):
                    place = place - np.int32(to * block)
                    if n > block:
                        met = (place >= 0) & (place < len(y))
                        got.append((perm, float(x[met] @ y[place[met]])))
                    else:
                        got.append((perm, float(x @ y[place])))
                yield pa.record_batch([pa.array([p for p, _ in got], pa.int32()), pa.array([s for _, s in got], pa.float64())], names=["perm", "x"])

    return tasks.mapInArrow(run, "perm int, x double").groupBy("perm").agg(F.sum("x").alias("x"))


def resampled_ranks(cells: DataFrame, groups: int, reps: int, seed: int, block: int = 1 << 14) -> DataFrame:
    """(rep, n, xx, yy, xy): rows and centred sums of squares and products of the mid-ranks of two sides, in each replicate of drawn groups.

    cells (g, x, y, w) counts rows by group, 0..groups - 1, and by the place, from 0, of each side's value among its distinct ones. A replicate
    is how often each group is drawn, so it weighs counts and no row is repeated. Values come in blocks; a task has the counts of one block of each
    side by group, what lies before them, the cells where both meet, and some replicates. So its memory is bounded by block values times groups.
    """
    cells = cells.withColumns({f"{c}_block": F.floor(F.col(c) / block) for c in "xy"})
    packed = cells.groupBy("x_block", "y_block").agg(F.collect_list(F.struct("g", (F.col("x") % block).alias("x"), (F.col("y") % block).alias("y"), "w")).alias("cells"))
    for c in "xy":
        own = cells.groupBy(f"{c}_block", F.col(c).alias("v"), "g").agg(F.sum("w").alias("w"))
        totals = own.groupBy(F.col(f"{c}_block").alias("of"), "g").agg(F.sum("w").alias("w"))
        sums = totals.crossJoin(own.select(f"{c}_block").distinct()).groupBy(f"{c}_block", "g").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("of") < F.col(f"{c}_block"), F.col("w")).otherwise(0)).alias("before"))
        lists = own.groupBy(f"{c}_block").agg(F.array_sort(F.collect_list(F.struct((F.col("v") % block).alias("v"), "g", "w"))).alias(f"{c}_counts"))
        packed = packed.join(lists, f"{c}_block").join(sums.groupBy(f"{c}_block").agg(F.collect_list(F.struct("g", "all", "before")).alias(f"{c}_sums")), f"{c}_block")
    chunks = min(reps, 32)
    tasks = dealt(packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")), "x_block", "y_block", "chunk")

    def ranks(counts, sums, times, n):
        weights, starts = counts["w"] * times[counts["g"]], np.flatnonzero(np.diff(counts["v"], prepend=-1))
        ties = np.add.reduceat(weights, starts)
        out = np.zeros(int(counts["v"][-1]) + 1)
        out[counts["v"][starts]] = sums["before"] @ times[sums["g"]] + np.cumsum(ties) - ties + (ties + 1) / 2 - (n + 1) / 2
        return out

    def run(batches):
        inner = [str(j) for j in range(groups)]
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("cells", "x_counts", "y_counts", "x_sums", "y_sums")
            for chunk, *own in zip(batch.column("chunk").to_pylist(), *(pieces(batch, name) for name in names), strict=True):
                met, x_counts, y_counts, x_sums, y_sums = own
                got = []
                for rep in range(chunk, reps, chunks):
                    times = np.bincount(draw_grid([f"{seed}|{rep}|"], inner, [""])[0] % groups, minlength=groups).astype(float)
                    n = x_sums["all"] @ times[x_sums["g"]]
                    x, y = ranks(x_counts, x_sums, times, n)[met["x"]], ranks(y_counts, y_sums, times, n)[met["y"]]
                    weights = met["w"] * times[met["g"]]
                    got.append((rep, n, *(float(weights @ (p * q)) for p, q in ((x, x), (y, y), (x, y)))))
                kinds = [pa.int32(), *[pa.float64()] * 4]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["rep", "n", "xx", "yy", "xy"])

    return tasks.mapInArrow(run, "rep int, n double, xx double, yy double, xy double").groupBy("rep").agg(F.max("n").cast("bigint").alias("n"), *[F.sum(c).alias(c) for c in ("xx", "yy", "xy")]).where("n > 0")
