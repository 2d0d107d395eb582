"""Fill-in-middle transformation: both cuts of a text are reached in an indexable skip list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: One link in so many of a lane is also in the lane above.
EVERY = 8


class SkipList:
    """The tokens of a text under express lanes.

    A token is a run of letters A-Z and a-z or one other code point. Each link of a lane has two widths: the units (tokens) and the
    code points that it passes. A lane's links are joined to those of the lane above where the hash of
    a token's rank says so, and their widths are added, so `points` never counts from the start of the text.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = (codes | 32) - np.uint32(97) < 26
        first = ~letter
        first[1:] |= ~letter[:-1]
        first[:1] = True
        rank = np.flatnonzero(first)
        points = np.diff(np.append(rank, len(codes)))
        self.n = len(points)
        self.lanes = [(np.ones(self.n, np.int64), points, None)]
        height = (np.arange(self.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        while len(self.lanes[-1][0]) > 2 * EVERY:
            up = height % np.uint64(EVERY) == 0
            up[0] = True
            at = np.flatnonzero(up)
            units, points, _ = self.lanes[-1]
            self.lanes.append((np.add.reduceat(units, at), np.add.reduceat(points, at), np.append(at, len(units))))
            height = height[at] // np.uint64(EVERY)
            if len(at) == len(up):
                break

    def points(self, rank: int) -> int:
        """Code points of the first `rank` tokens: from the highest lane down, each as far as its units allow."""
        i = units = points = 0
        for wide, long, down in reversed(self.lanes):
            while i < len(wide) and units + wide[i] <= rank:
                units, points, i = units + int(wide[i]), points + int(long[i]), i + 1
            if down is not None:
                i = int(down[i])
        return points


def cuts(texts: list[str], a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Of each text: its tokens n, and the code points before the smaller and the larger of a % (n + 1) and b % (n + 1) tokens."""
    out = []
    for text, x, y in zip(texts, a, b, strict=True):
        own = SkipList(text)
        low, high = sorted((x % (own.n + 1), y % (own.n + 1)))
        out.append((own.n, own.points(low), own.points(high)))
    return out


def _cuts(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    found = np.array(cuts(text.to_pylist(), a.to_pylist(), b.to_pylist()), np.int64).reshape(-1, 3)
    return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], ["n", "low", "high"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, spm_percent: int = 20, plain_percent: int = 10, keep=("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns in keep, n, form, prefix_chars, middle_chars, output.

    The cuts and the form follow from the digest of `seed:id`, so a rerun of a lost task gives the same rows, and nothing is
    shuffled. A null or empty text has no token and stays plain; a text that holds a mark stays plain, so that `restored` is
    exact. A null id is hashed as an empty one; rows that repeat an id are cut by the same numbers; an empty table gives an
    empty result; other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint")
    rows = docs.select(F.struct(*keep).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("own", "text", *[number(i).alias(f"h{i + 1}") for i in range(4)])
    cut = F.arrow_udf(_cuts, "struct<n: bigint, low: bigint, high: bigint>")
    rows = rows.select("*", cut("text", "h1", "h2").alias("cut"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("own", "text", form.alias("form"), F.col("cut.n").alias("n"), F.col("cut.low").cast("int").alias("low"), F.col("cut.high").cast("int").alias("high"))
    part = lambda start, length: F.substr("text", start, length)
    prefix, middle, suffix = part(F.lit(1), F.col("low")), part(F.col("low") + 1, F.col("high") - F.col("low")), part(F.col("high") + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    chars = lambda c: F.when(F.col("form") != "plain", c.cast("bigint"))
    return rows.select("own.*", "n", "form", chars(F.col("low")).alias("prefix_chars"), chars(F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form; marks are found by the first place where they stand, as no text that was cut holds one."""
    first, second = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    size = len(PREFIX)
    at = F.instr(output, second)
    end = F.instr(output, F.lit(MIDDLE))
    one, two = F.substr(output, F.length(first) + 1, at - size - 1), F.substr(output, at + size, end - at - size)
    middle = F.substr(output, end + size, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
