"""Quality rules: base rules and minimum-covariance-determinant outliers, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, row_key, small_or_shuffled, without, written

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics and the least spread that counts as variation in each.
DIMS = {"x0": 0.10, "x1": 0.35, "x2": 0.35, "x3": 0.15}


def _repeats(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more.

    Each window becomes one long: hash bits above, its position in as many bits as the text needs
    below. After sorting, windows alike stand side by side. Only repeated positions go further; sorted,
    a position covers as many words as there are to the next, three at most.
    """

    def up(x, b):
        return F.call_function("shiftleft", x, b)

    def down(x, b):
        return F.call_function("shiftright", x, b)

    def packed(ws):
        bits = F.ceil(F.log2(F.size(ws).cast("double") + 2)).cast("int")
        key = lambda i, b: up(F.xxhash64(ws[i], ws[i + 1], ws[i + 2]), b).bitwiseOR(i.cast("bigint"))
        return let(bits, lambda b: let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: key(i, b))), lambda s: covered(s, b)))

    def covered(s, b):
        beside = lambda x, y: F.coalesce(down(x, b) == down(y, b), F.lit(False))
        twice = F.filter(s, lambda x, i: beside(F.get(s, i + 1), x) | beside(F.get(s, i - 1), x))
        spots = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(up(F.lit(1).cast("bigint"), b) - 1)))
        steps = lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return let(spots, lambda p: F.aggregate(steps(p), F.lit(0).cast("bigint"), lambda a, x: a + x))

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(packed(words))


def statistics(text: Column) -> Column:
    """Struct of STATS for one text; null and wordless texts are all zero."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("bigint")
    return let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"), _repeats(w).alias("n_repeat_words")))


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep=("doc_id",)) -> DataFrame:
    """Statistics written once to the shared folder: struct own, group, STATS, base_failed, DIMS."""
    rows = docs.select(F.struct(*keep).alias("own"), F.to_json(F.struct(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).alias("grp"), statistics(F.col(text_col)).alias("s"))
    rows = written(rows.select("own", "grp", "s.*"), "statistics")
    words = F.greatest("n_words", F.lit(1)).cast("double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed")).select(
        "*",
        F.log(F.greatest("word_chars", F.lit(1)) / words).alias("x0"),
        F.log1p(100 * F.col("n_symbols") / words).alias("x1"),
        F.log1p(100 * F.col("n_dup_lines") / words).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x3"),
    )


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _covariances(rows: DataFrame) -> DataFrame:
    """Rows (n), means (m) and covariances (c) by group and start; a variance under the floor of its statistic is raised to it.

    The floor (a regularised determinant) keeps the matrix regular where a statistic is constant in
    most of a group; groups with ample spread are left as they are.
    """
    names = list(DIMS)
    got = rows.groupBy("grp", "start").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i, j in _pairs()])
    return _floored(got)


def _floored(got: DataFrame) -> DataFrame:
    return got.withColumns({f"c{i}{i}": F.greatest(f"c{i}{i}", F.lit(floor**2)) for i, floor in enumerate(DIMS.values())})


def _moments(got: DataFrame) -> DataFrame:
    """The table of _covariances with its precision matrices (p) and log-determinants, by elimination on the small group table."""
    n, pairs, own = len(DIMS), _pairs(), got.columns
    for i, j in sorted(pairs):  # Cholesky factor, row by row
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        got = got.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(n):  # its inverse, column by column
        for i in range(j, n):
            if i == j:
                got = got.withColumn(f"v{i}{j}", 1 / F.col(f"l{i}{i}"))
            else:
                rest = sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j + 1, i)), F.col(f"l{i}{j}") * F.col(f"v{j}{j}"))
                got = got.withColumn(f"v{i}{j}", -rest / F.col(f"l{i}{i}"))
    precision = [sum((F.col(f"v{k}{i}") * F.col(f"v{k}{j}") for k in range(i + 1, n)), F.col(f"v{i}{i}") * F.col(f"v{i}{j}")).alias(f"p{i}{j}") for i, j in pairs]
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, n)), 2 * F.log("l00")).alias("det")
    return got.select(*own, *precision, det)


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns of DIMS and of _moments."""
    names = list(DIMS)
    off = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(names)]
    terms = [F.col(f"p{i}{j}") * off[i] * off[j] * (1 if i == j else 2) for i in range(len(names)) for j in range(i + 1)]
    return sum(terms[1:], terms[0])


def estimates(rows: DataFrame, share: float, steps: int, broadcast_rows: int) -> DataFrame:
    """Minimum-covariance-determinant estimate by group: two starts, concentration steps until no determinant falls by more, the smaller determinant.

    Starts take the rows nearest the coordinatewise median, by the sum and by the largest of the deviations
    scaled by their own median (floored alike); a step keeps the `share` of a group's rows nearest the current estimate.
    Quantiles and moments are aggregates with map-side combine, so a hot group never meets in a task.
    """
    names = list(DIMS)
    mids = rows.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"med{i}") for i, c in enumerate(names)])
    rows = rows.join(small_or_shuffled(written(mids, "medians"), broadcast_rows), "grp").select("grp", *names, *[F.abs(F.col(c) - F.col(f"med{i}")).alias(f"off{i}") for i, c in enumerate(names)])
    spreads = rows.groupBy("grp").agg(*[F.greatest(1.4826 * F.percentile_approx(f"off{i}", 0.5, 1000), F.lit(DIMS[c])).alias(f"mad{i}") for i, c in enumerate(names)])
    rows = rows.join(small_or_shuffled(written(spreads, "spreads"), broadcast_rows), "grp")
    far = [F.col(f"off{i}") / F.col(f"mad{i}") for i in range(len(names))]
    both = rows.select("grp", *names, F.explode(F.array(F.struct(F.lit(0).alias("start"), sum(far[1:], far[0]).alias("d")), F.struct(F.lit(1).alias("start"), F.greatest(*far).alias("d")))).alias("s")).select("grp", *names, "s.start", "s.d")

    def nearest(scored: DataFrame) -> DataFrame:
        cut = scored.groupBy("grp", "start").agg(F.percentile_approx("d", share, 1000).alias("cut"))
        return scored.join(small_or_shuffled(cut, broadcast_rows), ["grp", "start"]).where("d <= cut")

    now, last = written(_moments(_covariances(nearest(both))), "mcd"), None
    for _ in range(steps):
        scored = both.drop("d").join(small_or_shuffled(now, broadcast_rows), ["grp", "start"]).select("grp", "start", *names, _distance().alias("d"))
        last, now = now, written(_moments(_covariances(nearest(scored))), "mcd")
        moved = now.select("grp", "start", "det").join(last.select("grp", "start", F.col("det").alias("was")), ["grp", "start"]).where("was - det > 1e-3")
        if moved.isEmpty():
            break
    return now.groupBy("grp").agg(F.min_by(F.struct("n", *[c for c in now.columns if c[0] in "mc"]), F.struct("det", "start")).alias("e")).select("grp", "e.*")


def shrunk(own: DataFrame, weight: float) -> DataFrame:
    """Estimates drawn to the one of all groups together, as if each had `weight` more rows of it: (grp, n, m, c, p, det).

    The estimate of all has the groups' mean, and their covariances within and between, by rows. Its share is weight / (n + weight) at
    every size, so large groups stand for themselves and a group of one row is judged by all.
    """
    names, share = range(len(DIMS)), F.col("n") / (F.col("n") + weight)
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    every = own.agg(*[mean(F.col(f"m{i}")).alias(f"am{i}") for i in names], *[mean(F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"as{i}{j}") for i, j in _pairs()])
    both = own.join(F.broadcast(every))  # one row
    drawn = lambda x, y: share * x + (1 - share) * y
    means = [drawn(F.col(f"m{i}"), F.col(f"am{i}")).alias(f"m{i}") for i in names]
    covariances = [drawn(F.col(f"c{i}{j}"), F.col(f"as{i}{j}") - F.col(f"am{i}") * F.col(f"am{j}")).alias(f"c{i}{j}") for i, j in _pairs()]
    return _moments(_floored(both.select("grp", "n", *means, *covariances)))


def cutoff(share: float, tail: float) -> float:
    """The squared distance that a clean normal row of len(DIMS) = 4 statistics passes with probability tail.

    The chi-square quantile, over the factor by which the covariance of the `share` nearest rows is too small. For even
    numbers of statistics both distributions have closed forms.
    """
    def above(x: float, half: int) -> float:  # P(chi-square of 2 * half > x)
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))

    def quantile(p: float, half: int) -> float:
        low, high = 0.0, 1e4
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if above(mid, half) > p else (low, mid)
        return low

    half = len(DIMS) // 2
    return quantile(tail, half) * share / (1 - above(quantile(1 - share, half), half + 1))


def _judged(docs, text_col, lang_col, source_col, keep, share, steps, tail, weight, broadcast_rows):
    rows = measured(docs, text_col, lang_col, source_col, keep)
    good = rows.where(~F.col("base_failed")).select("grp", *DIMS)
    made = small_or_shuffled(written(shrunk(estimates(good, share, steps, broadcast_rows), weight), "mcd"), broadcast_rows)
    scored = rows.join(made, "grp", "left").select("own", *STATS, "base_failed", _distance().alias("distance"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff(share, tail), F.lit(True))
    return scored.withColumn("kept", kept)


def rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep=("doc_id",), share: float = 0.75, steps: int = 8, tail: float = 2e-5, weight: float = 30, broadcast_rows: int = 20_000) -> DataFrame:
    """The columns in keep, STATS, base_failed, distance and kept for every row.

    kept is false if a base rule fails; else it is the method's verdict: the squared Mahalanobis
    distance of (log mean word length, log symbol rate, log duplicate-line rate, root of the repeated
    share) from the estimate of the row's language and source is at most what a clean row exceeds with probability `tail`
    (see cutoff). Estimates come from all rows that pass the base rules, and each counts `weight` rows of the estimate over
    all groups besides its own (see shrunk). Without any such row nothing is left to judge. Null language and source are groups
    of their own; null and empty texts fail the base rule; repeated rows each count and give a row;
    an empty table gives an empty result; columns outside keep are not read, and kept ones travel in
    a struct, so their names cannot clash inside. Group tables are broadcast only up to broadcast_rows.
    """
    got = _judged(docs, text_col, lang_col, source_col, keep, share, steps, tail, weight, broadcast_rows)
    return got.select("own.*", *STATS, "base_failed", "distance", "kept")


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, steps: int = 8, tail: float = 2e-5, weight: float = 30, broadcast_rows: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, that rules() keeps. The verdict is one of text, language and source: only their keys are joined back.

    Nulls, empty and long texts, ties and repeated rows are judged as there (rows alike share a verdict); an empty table stays empty.
    """
    of = (text_col, lang_col, source_col)
    keyed = docs.select(*of, *row_key(*of))
    got = _judged(keyed, text_col, lang_col, source_col, ("key_1", "key_2"), share, steps, tail, weight, broadcast_rows)
    return without(docs, written(got.where("not kept").select("own.*").distinct(), "rejected"), of)
