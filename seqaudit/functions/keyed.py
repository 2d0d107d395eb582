"""Randomness by keyed hashing: independent of order and partitioning, and the same in SQL."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(*keys: Column | int | str) -> Column:
    """A whole number in [0, 2**32) from the keys' text."""
    text = F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*keys: Column | int | str) -> Column:
    """A number in [0, 1) from the keys' text."""
    return draw(*keys) / float(1 << 32)


def shuffled_place(df: DataFrame, place: str, n: str, keys: list[Column | int | str], out: str, rounds: int = 4) -> DataFrame:
    """df with out: the place of 0..n-1 that a shuffle drawn by keys sends `place` to. Each row finds its own without a sort.

    A Feistel network: a place is two digits of base ceil(sqrt(n)); each round swaps them and shifts one by a hash of the other, so every
    round is one to one. Places past n - 1 go through it again until they are inside; 64 times at most, which is never reached, as
    under n = 1024 no such walk is that long and over it the odds are below 2 ** -256.
    """
    base = F.greatest(F.ceil(F.sqrt(F.col(n))), F.lit(1)).cast("bigint")
    turn = lambda left, right, j: (left + draw(*keys, j, right)) % F.col("_a")
    own = df.withColumn("_a", base).withColumn("_l", F.floor(F.col(place) / F.col("_a"))).withColumn("_r", F.col(place) % F.col("_a"))
    for j in range(rounds):
        own = own.withColumns({"_l": F.col("_r"), "_r": turn(F.col("_l"), F.col("_r"), j)})
    inside = lambda left, right: left * F.col("_a") + right < F.col(n)

    def step(acc, s):
        j = s % rounds
        stop = acc["stop"] | ((j == 0) & inside(acc["l"], acc["r"]))
        return F.when(stop, F.struct(acc["l"].alias("l"), acc["r"].alias("r"), F.lit(True).alias("stop"))).otherwise(F.struct(acc["r"].alias("l"), turn(acc["l"], acc["r"], j).alias("r"), F.lit(False).alias("stop")))

    start = F.struct(F.col("_l").cast("bigint").alias("l"), F.col("_r").cast("bigint").alias("r"), F.lit(False).alias("stop"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(64 * rounds)), start, step, lambda acc: acc["l"] * F.col("_a") + acc["r"])
    got = F.when(inside(F.col("_l"), F.col("_r")), F.col("_l") * F.col("_a") + F.col("_r")).otherwise(walked)
    return own.withColumn(out, got.cast("bigint")).drop("_a", "_l", "_r")


_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]


def _md5_head(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of texts that fill one padded block each, as whole numbers: block [r, c] is rows[r] + columns[c], 16 words each.

    A word alike in all rows and columns goes into the constant of its round, and rounds before the first other word are done once.
    """
    words, lead = [], 0
    for g in range(16):
        x, y = rows[:, g], columns[:, g]
        same = [bool((v == v[0]).all()) for v in (x, y)]
        words.append((int(x[0]) * same[0] + int(y[0]) * same[1], None if same[0] else x[:, None].copy(), None if same[1] else y[None, :].copy()))
        lead += lead == g and all(same)
    a, b, c, d = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
    for i in range(lead):
        f = (a + ((b & c) | (~b & d)) + _SINES[i] + words[i][0]) & 0xFFFFFFFF
        s = _SHIFTS[0][i % 4]
        a, b, c, d = d, (b + (f << s | f >> (32 - s))) & 0xFFFFFFFF, b, c
    a, b, c, d = (np.full((len(rows), len(columns)), v, np.uint32) for v in (a, b, c, d))
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(lead, 61):  # the last three rounds leave the first word
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        known, *others = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        np.add(a, f, out=f), np.add(f, np.uint32((_SINES[i] + known) & 0xFFFFFFFF), out=f)
        for x in others:
            if x is not None:
                np.add(f, x, out=f)
        s = _SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t), np.left_shift(f, np.uint32(s), out=f)
        np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return np.add(b, np.uint32(0x67452301), out=f).byteswap(inplace=True)


def draw_grid(before: list[str], inner: list[str], after: list[str], at_once: int = 32768, dtype=np.int64) -> np.ndarray:
    """draw() in numpy inside a task, for texts known by row and column: [r, c] is the draw of the text before[r] + inner[c] + after[r].

    Texts of equal lengths are hashed together, `at_once` at a time so that they stay in the cache; one that is over a block of md5 is hashed
    alone. Results are those of draw(); dtype may be np.uint32, which holds them too.
    """
    rows, columns = [(a.encode(), b.encode()) for a, b in zip(before, after, strict=True)], [x.encode() for x in inner]
    out = np.empty((len(rows), len(columns)), dtype)
    by_row: dict = {}
    for r, (a, b) in enumerate(rows):
        by_row.setdefault((len(a), len(b)), []).append(r)
    by_column: dict = {}
    for c, x in enumerate(columns):
        by_column.setdefault(len(x), []).append(c)
    for (la, lb), own in by_row.items():
        for lx, cs in by_column.items():
            n = la + lx + lb
            if n > 55:
                for r in own:
                    out[r, cs] = [int.from_bytes(hashlib.md5(rows[r][0] + columns[c] + rows[r][1]).digest()[:4]) for c in cs]
                continue
            heads, tails, middles = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in ([rows[r][0] for r in own], [rows[r][1] for r in own], [columns[c] for c in cs]))
            outer, between = np.zeros((len(own), 64), np.uint8), np.zeros((len(cs), 64), np.uint8)
            outer[:, :la], outer[:, la + lx : n], between[:, la : la + lx] = heads, tails, middles
            outer[:, n], outer[:, 56], outer[:, 57] = 128, (8 * n) & 255, (8 * n) >> 8
            outer, between = outer.view("<u4"), between.view("<u4")
            wide = max(1, at_once // len(cs))
            for low in range(0, len(own), wide):
                for left in range(0, len(cs), at_once):
                    out[np.ix_(own[low : low + wide], cs[left : left + at_once])] = _md5_head(outer[low : low + wide], between[left : left + at_once])
    return out


def keyed_text(*keys) -> str:
    """The text that draw() hashes: keys joined by bars, nulls left out."""
    return "|".join(str(k) for k in keys if k is not None)
