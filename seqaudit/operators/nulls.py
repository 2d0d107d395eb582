"""Tail probabilities and permutation nulls as grouped queries."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join, upper_tail
from ..functions.tails import Hypergeometric, binomial_at_least
from . import draws, intervals
from .statistics import average_rank


def hypergeom_top(track: DataFrame, spans: DataFrame, q: float, key: str = "accession", cls: str = "cls") -> DataFrame:
    """P(X >= a) that a of the top positions lie in a class, and their share over the class's share."""
    top = intervals.top_quantile(track, q, key).where("is_top")
    sizes = track.groupBy(key).agg(F.count("*").alias("n")).join(top.groupBy(key).agg(F.count("*").alias("r")), key)
    merged = intervals.merge_intervals(spans, [key, cls]).groupBy(key, cls).agg(F.sum(F.col("s1") - F.col("s0")).alias("k"))
    hits = intervals.point_in_interval(top.select(key, "pos"), spans, key, cls).groupBy(key, cls).agg(F.count("*").alias("a"))
    got = merged.where("k > 0").join(sizes, key).join(hits, [key, cls], "left").fillna(0, ["a"])
    n, r, k = (F.col(c) for c in ("n", "r", "k"))
    return Hypergeometric(got, n, r, k).at_least(F.col("a"), "p").select(key, cls, "n", "r", "k", "a", "p", (F.col("a") / r / (k / n)).alias("enrichment"))


def binom_sign(df: DataFrame, by: str, k: str, n: str, p0: str) -> DataFrame:
    """P(K >= k) of n draws at p0, which is held within [1e-6, 1 - 1e-6], and p_half, the same at 0.5. Exact for any n."""
    p = F.least(F.greatest(F.col(p0), F.lit(1e-6)), F.lit(1 - 1e-6))
    own = binomial_at_least(df.select(by, k, n, p.alias("_p0")), F.col(n), F.col(k), F.col("_p0"), "p")
    return binomial_at_least(own, F.col(n), F.col(k), F.lit(0.5), "p_half").drop("_p0")


def wilcoxon(deltas: DataFrame, by: str, value: str, exact_to: int = 60, min_n: int = 5) -> DataFrame:
    """Two-sided signed-rank test of each group; zeros and nulls go. Exact up to exact_to differences, else the normal form.

    The exact null is built rank by rank: the shares of all sums of doubled ranks (whole numbers also with ties), halved and shifted for the
    next rank. So n differences take n steps over n * (n + 1) shares; sign patterns are not listed.
    """
    ranked = average_rank(deltas.where(F.col(value) != 0).select(by, value, F.abs(value).alias("_a")), "_a", [by], "_rank")
    sums = ranked.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(value) > 0, F.col("_rank")).otherwise(0.0)).alias("w"), F.sum(F.col("_rank") * F.col("_rank")).alias("_sq")).where(F.col("n") >= min_n)
    middle = F.col("n") * (F.col("n") + 1) / 4
    small = sums.where(F.col("n") <= exact_to)
    ranks = ranked.join(small.select(by), by, "left_semi").groupBy(by).agg(F.sort_array(F.collect_list((F.col("_rank") * 2).cast("int"))).alias("_ranks"))
    zeros = lambda r: F.array_repeat(F.lit(0.0), r)
    shares = F.aggregate("_ranks", F.array(F.lit(1.0)), lambda own, r: F.zip_with(F.concat(own, zeros(r)), F.concat(zeros(r), own), lambda x, y: (x + y) / 2))
    far = F.abs(F.col("w") - middle) - 1e-9
    p = F.aggregate(F.transform("_shares", lambda x, i: F.when(F.abs(i / 2 - middle) >= far, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    exact = small.join(ranks, by).select(by, "n", "w", shares.alias("_shares")).select(by, "n", "w", F.least(p, F.lit(1.0)).alias("p"))
    z = F.abs(F.col("w") - middle) / F.sqrt(F.col("_sq") / 4)
    return exact.unionByName(sums.where(F.col("n") > exact_to).select(by, "n", "w", (2 * upper_tail(z)).alias("p")))


def stouffer(z: DataFrame, by: str, value: str = "z") -> DataFrame:
    """Sum of z over the root of their number, and its one-sided p."""
    got = z.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), (F.sum(value) / F.sqrt(F.count("*"))).alias("t"))
    return got.withColumn("p", upper_tail("t"))


def residualize(df: DataFrame, y: str, covariates: list[str], by: list[str] | None = None, dummies: str | None = None) -> DataFrame:
    """df with residual: y less its least-squares fit on the covariates and an intercept, or on them and the dummies of a class column.

    Each group of `by` has a fit of its own. With dummies all is centred in each class first, which leaves the same slopes; then one pass
    gathers the cross products of a group, and the small solve of a group runs on the executors (the least-norm one where covariates depend on one
    another). Rows with a null or NaN in y, a covariate, the class or by take no part and get a null residual.
    """
    by, cls = list(by or []), [dummies] if dummies else []
    cols = [y, *covariates]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    whole = functools.reduce(operator.and_, [value(c).isNotNull() for c in cols] + [F.col(c).isNotNull() for c in (*by, *cls)])
    rows = df.withColumns({f"_c{i}": F.when(whole, value(c)) for i, c in enumerate(cols)})
    keys = [*by, *cls]
    cells = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    products = [(F.covar_pop(f"_c{i}", f"_c{j}") * F.count(f"_c{i}")).alias(f"_s{i}_{j}") for i, j in cells]
    each = rows.where("_c0 is not null").groupBy(*keys).agg(*[F.avg(f"_c{i}").alias(f"_m{i}") for i in range(len(cols))], *products)
    summed = each.groupBy(*by).agg(*[F.sum(f"_s{i}_{j}").alias(f"_s{i}_{j}") for i, j in cells]) if cls else each
    flat = summed.select(*by, F.array(*[F.col(f"_s{i}_{j}") for i, j in cells]).alias("_s"))
    d = len(cols)

    def solve(batches):
        for batch in batches:
            out = []
            for flat in batch.column("_s").to_pylist():
                m = np.zeros((d, d))
                for (i, j), v in zip(cells, flat, strict=True):
                    m[i, j] = m[j, i] = np.nan if v is None else v
                out.append(np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=1e-12)[0].tolist() if np.isfinite(m).all() else None)
            yield pa.record_batch([*[batch.column(c) for c in by], pa.array(out, pa.list_(pa.float64()))], names=[*by, "_w"])

    kinds = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], "_w array<double>"])
    slopes = flat.mapInArrow(solve, kinds)
    means = each.select(*keys, *[f"_m{i}" for i in range(d)])
    met = null_safe_join(null_safe_join(rows, means, keys, "left"), slopes, by, "left")
    fit = sum(((F.col(f"_c{i}") - F.col(f"_m{i}")) * F.col("_w")[i - 1] for i in range(1, d)), F.lit(0.0))
    return met.select(*df.columns, (F.col("_c0") - F.col("_m0") - fit).alias("residual"))


def residualize_groups(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    """Residual of y on a class variable (its dummies with intercept): y less its mean in the class; null y stays null."""
    return df.join(df.groupBy(*by).agg(F.avg(y).alias("_m")), by).withColumn("residual", F.col(y) - F.col("_m")).drop("_m")


def placement_null(fragments: DataFrame, genomes: DataFrame, spans: DataFrame, b: int, length: int, share: float = 0.5, seed: int = 42) -> DataFrame:
    """Share of fragments lying in each class against random placements: observed, null mean, 95 % point and p.

    fragments has (accession, frag_id, frag_start); one at a random start of its genome in each permutation. A fragment is one row with its
    genome's spans, which makes its draws in numpy; tasks send counts by class and permutation.
    """
    sized = fragments.join(genomes, "accession").where(F.col("n") >= length)
    merged = intervals.merge_intervals(spans.where("s1 > s0"), ["accession", "cls"])
    own = merged.groupBy("accession").agg(F.collect_list(F.struct("cls", F.col("s0").cast("bigint").alias("s0"), (F.col("s1") - F.col("s0")).cast("bigint").alias("len"))).alias("spans"))
    text = F.concat_ws("|", "accession", "frag_id").alias("text")
    rows = draws.dealt(sized.join(own, "accession").select(text, F.col("frag_start").cast("bigint").alias("frag_start"), F.col("n").cast("bigint").alias("n"), "spans"), "text")
    hits = draws.placed_hits(rows, b, length, share, seed)
    grid = spans.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(0), F.lit(b))).alias("perm"))
    n = F.broadcast(sized.agg(F.count("*").alias("_n")))
    shares = grid.join(hits, ["cls", "perm"], "left").join(n, F.lit(True)).select("cls", "perm", (F.coalesce("h", F.lit(0)) / F.col("_n")).alias("x"))
    seen = shares.where("perm = 0").select("cls", F.col("x").alias("observed"))
    null = shares.where("perm > 0").join(seen, "cls")
    return null.groupBy("cls", "observed").agg(F.avg("x").alias("null_mean"), F.percentile("x", F.lit(0.95)).alias("null_p95"), ((1 + F.count_if(F.col("x") >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))


def position_perm(windows: DataFrame, b: int, seed: int = 42) -> DataFrame:
    """Top windows drawn anew, b times: observed log odds ratio (Haldane), null mean, two-sided p, the null odds ratio's mean and 95 % interval, and a gate.

    windows has (accession, window_index, is_top, cls, inside). Only the drawn window of a genome moves from low to high, so the rest of a table
    follows from totals. A genome is one row that makes its draws in numpy; tasks send counts by class and permutation. The gate is `keep_primary` where p is under 0.05 and the
    observed ratio over the null's upper end or mean, `directional_downgrade` where it is over 1 without that p, else `null_reproduces_or_nonspecific`.
    """
    row = F.struct(F.col("window_index").cast("bigint").alias("window_index"), F.coalesce("is_top", F.lit(False)).alias("top"), "cls", F.coalesce(F.col("inside").cast("bigint"), F.lit(0)).alias("inside"))
    genomes = windows.groupBy("accession").agg(F.collect_list(row).alias("windows")).select(F.col("accession").cast("string").alias("text"), "windows")
    high = draws.top_windows(draws.dealt(genomes, "text"), b, seed)
    every = high.where("perm = 0").select("cls", F.col("inside").alias("_in"), F.col("every").alias("_all"))
    a, h = F.col("a"), F.col("high")
    tables = high.where("high > 0").join(every, "cls").select("cls", "perm", *[(x + 0.5).alias(c) for c, x in zip("abcd", (a, h - a, F.col("_in") - a, F.col("_all") - h - F.col("_in") + a), strict=True)])
    odds = tables.select("cls", "perm", F.round(F.log(F.col("a") * F.col("d") / (F.col("b") * F.col("c"))), 6).alias("x"))
    null = odds.where("perm > 0").join(odds.where("perm = 0").select("cls", F.col("x").alias("observed")), "cls")
    ratio = F.round(F.exp("x"), 6)
    got = null.groupBy("cls", "observed").agg(
        F.avg("x").alias("null_mean"),
        ((1 + F.count_if(F.abs("x") >= F.abs("observed"))) / (1 + F.count("*"))).alias("p"),
        F.avg(ratio).alias("null_or"),
        F.percentile(ratio, F.lit(0.025)).alias("null_or_low"),
        F.percentile(ratio, F.lit(0.975)).alias("null_or_high"),
    )
    seen = F.round(F.exp("observed"), 6)
    keep = (F.col("p") < 0.05) & ((F.col("null_or_high") < seen) | (seen > F.col("null_or")))
    return got.withColumn("gate", F.when(keep, "keep_primary").when((seen > 1) & (F.col("p") >= 0.05), "directional_downgrade").otherwise("null_reproduces_or_nonspecific"))
