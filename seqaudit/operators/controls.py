"""Further nulls, percentiles, codon comparisons and block tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up
from . import draws, intervals, splits
from .statistics import average_rank

#: The standard genetic code, codons in the order TCAG of each base.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def shift_top_null(track: DataFrame, spans: DataFrame, q: float, b: int, key: str = "accession", cls: str = "cls", seed: int = 42) -> DataFrame:
    """Circular-shift null of the share of top positions that lie in a class: the classes move against the top positions, a genome a row as in shift_null.

    The mean comes from whole counts, rounded as SQL's engine rounds.
    """
    top = intervals.top_quantile(track, q, key).where("is_top").select(key, "pos", F.lit(1.0).alias("attr"))
    rows = draws.genome_rows(top, intervals.merge_intervals(spans, [key, cls]), track.groupBy(key).agg(F.count("*").alias("n")), key, cls)

    def null(scores, times, k):
        hits = np.rint(scores)
        return hits[0] / k, (1 + int(times[hits >= hits[0]].sum())) / (1 + b), float(times @ hits) / k / b

    got = draws.shifted(rows, b, seed, key, cls, null, "observed double, p double, null_mean double", back=True)
    return got.withColumn("null_mean", half_up(F.col("null_mean")))


def label_perm_global(df: DataFrame, id_col: str, pred: str, y: str, b: int, seed: int = 42) -> DataFrame:
    """Spearman of stored predictions with y, and its mean, sd and p when y is shuffled over all rows, b times.

    A shuffle moves ranks and leaves their mean and spread, so both sides are ranked once and a permutation is a sum of
    products, taken in numpy over blocks of rows. Rows without either value go. All null if a side is constant.
    """
    known = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull()).select(F.col(id_col).alias("id"), F.col(pred).alias("pred"), F.col(y).alias("y"))
    ranked = average_rank(average_rank(known, "pred", [], "a"), "y", [], "b").select("id", "a", "b")
    fixed = ranked.agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.sqrt(F.var_pop("a") * F.var_pop("b")).alias("s"), F.sum(F.col("a") * F.col("b")).alias("seen"))
    sums = draws.permuted_sums(splits.hash_rank(ranked, "id", seed, "_i"), "a", "b", b, seed)
    rho = lambda x: F.round(F.try_divide(F.col(x) / F.col("n") - F.col("ma") * F.col("mb"), F.col("s")), 6)
    null = sums.join(F.broadcast(fixed), F.lit(True)).select(rho("x").alias("rho"), rho("seen").alias("observed"))
    p = (1 + F.count_if(F.col("rho") >= F.col("observed"))) / (1 + F.count("*"))
    return null.groupBy("observed").agg(F.avg("rho").alias("null_mean"), F.stddev_pop("rho").alias("null_sd"), F.when(F.col("observed").isNotNull(), p).alias("p"))


def locus_percentile(loci: DataFrame, track: DataFrame, key: str = "accession", cls: str = "cls") -> DataFrame:
    """Mean absolute score of each locus [s0, s1), and the share of equal tiles of its genome that have no more.

    Tiles do not overlap and start at 0; means come from prefix sums. Empty loci and ones past the end are left out.
    """
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = track.select(key, (F.col("pos") + 1).cast("bigint").alias("edge"), F.sum(F.abs("attr")).over(run).alias("cum"))
    sums = sums.unionByName(track.select(key).distinct().select(key, F.lit(0).cast("bigint").alias("edge"), F.lit(0.0).alias("cum")))
    size = track.groupBy(key).agg(F.count("*").alias("_n"))
    own = loci.join(size, key).where("s1 > s0 and s1 <= _n").withColumn("_l", (F.col("s1") - F.col("s0")).cast("bigint"))
    tiles = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_n") / F.col("_l")) - 1), lambda i: F.struct(i.alias("i"), (i * F.col("_l")).alias("a")))
    locus = F.array(F.struct(F.lit(-1).cast("bigint").alias("i"), F.col("s0").cast("bigint").alias("a")))
    each = own.select(key, cls, "s0", "s1", "_l", F.explode(F.concat(locus, tiles)).alias("t")).select(key, cls, "s0", "s1", "_l", "t.i", "t.a", (F.col("t.a") + F.col("_l")).alias("z"))
    each = each.join(sums.select(key, F.col("edge").alias("a"), F.col("cum").alias("lo")), [key, "a"]).join(sums.select(key, F.col("edge").alias("z"), F.col("cum").alias("hi")), [key, "z"])
    means = each.select(key, cls, "s0", "s1", "i", F.round((F.col("hi") - F.col("lo")) / F.col("_l"), 6).alias("m"))
    seen = means.where("i < 0").select(key, cls, "s0", "s1", F.col("m").alias("score"))
    got = means.where("i >= 0").join(seen, [key, cls, "s0", "s1"])
    return got.groupBy(key, cls, "s0", "s1", "score").agg((F.count_if(F.col("m") <= F.col("score")) / F.count("*")).alias("percentile"))


def _residue(codon: Column) -> Column:
    at = F.lit(1)
    for j, weight in enumerate((16, 4, 1)):
        at = at + weight * (F.position(F.substring(codon, j + 1, 1), F.lit(BASES)) - 1)
    return F.substr(F.lit(CODE), at, F.lit(1))


def codon_counts(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """Differences of aligned codons: (id, codons, syn, nonsyn, aa_diff, dn, ds, ratio).

    Characters other than A, C, G, T and - go; codons with a gap are skipped. Each codon counts
    2.25 nonsynonymous and 0.75 synonymous sites. Under three aligned codons the rates are null.
    """
    clean = lambda c: F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^ACGT-]", "")
    rows = pairs.select(F.col(id_col).alias("id"), clean(a).alias("x"), clean(b).alias("y"))
    rows = rows.withColumn("l", F.floor(F.least(F.length("x"), F.length("y")) / 3).cast("int"))
    spots = F.explode_outer(F.when(F.col("l") > 0, F.sequence(F.lit(0), F.col("l") - 1))).alias("i")
    each = rows.select("id", "x", "y", "l", spots).select("id", "l", *[F.substr(F.col(c), F.col("i") * 3 + 1, F.lit(3)).alias(c) for c in "xy"])
    counted = F.coalesce(~F.contains("x", F.lit("-")) & ~F.contains("y", F.lit("-")), F.lit(False))
    differ = sum((F.when(F.substring("x", j, 1) != F.substring("y", j, 1), 1).otherwise(0) for j in (1, 2, 3)), F.lit(0))
    same = _residue(F.col("x")) == _residue(F.col("y"))
    sums = each.groupBy("id").agg(F.max("l").alias("l"), F.count_if(counted).alias("codons"), F.coalesce(F.sum(F.when(counted & same, differ)), F.lit(0)).alias("syn"), F.coalesce(F.sum(F.when(counted & ~same, differ)), F.lit(0)).alias("nonsyn"), F.count_if(counted & ~same).alias("aa_diff"))
    rate = lambda c, sites: F.when(F.col("l") >= 3, F.col(c) / F.greatest(F.col("codons") * sites, F.lit(1e-9)))
    got = sums.withColumn("dn", rate("nonsyn", 2.25)).withColumn("ds", rate("syn", 0.75))
    return got.withColumn("ratio", F.col("dn") / F.greatest("ds", F.lit(1e-9))).drop("l").withColumnRenamed("id", id_col)


def f_tail(f: float, df1: int, df2: int) -> float:
    """P(F >= f), by the continued fraction of the incomplete beta function."""
    x = df2 / (df2 + df1 * max(f, 0.0))
    if x in (0.0, 1.0):
        return x
    if x > (df2 / 2 + 1) / ((df1 + df2) / 2 + 2):
        return 1 - f_tail(1 / f, df2, df1)
    a, b = df2 / 2, df1 / 2
    value = 0.0
    for m in range(400, 0, -1):
        k = m // 2
        d = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        value = d / (1 + value)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front / (1 + value)


def partial_f(df: DataFrame, y: str, block: list[str], group: str) -> DataFrame:
    """One row: F of a block of features given group dummies, from within-group cross products; the driver gets these sums only.

    Rows with a null in y, the block or the group are left out.
    """
    cols = [y, *block]
    rows = df.select(group, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    cells = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    each = rows.groupBy(group).agg(F.count("*").alias("n"), *[(F.covar_pop(f"c{i}", f"c{j}") * F.count("*")).alias(f"s{i}_{j}") for i, j in cells])
    r = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("g"), *[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in cells]).first()
    schema = "n bigint, df1 int, df2 bigint, rss_reduced double, rss_full double, f double, p double"
    if not r["n"]:
        return df.sparkSession.createDataFrame([], schema)
    s = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
    full = float(max(s[0, 0] - s[0, 1:] @ np.linalg.lstsq(s[1:, 1:], s[1:, 0], rcond=None)[0], 0.0))
    df1, df2 = len(block), max(1, r["n"] - r["g"] - len(block))
    f = (s[0, 0] - full) / df1 / (full / df2 + 1e-12)
    return df.sparkSession.createDataFrame([(r["n"], df1, df2, float(s[0, 0]), full, float(f), f_tail(float(f), df1, df2))], schema)


def pca_scores(df: DataFrame, features: str, k: int = 20) -> DataFrame:
    """df with scores: the first k principal components of the standardised features, an array column; signs are free."""
    rows = df.withColumn("_v", array_to_vector(features))
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True)
    got = Pipeline(stages=[scaler, PCA(k=k, inputCol="_z", outputCol="_p")]).fit(rows).transform(rows)
    return got.withColumn("scores", vector_to_array("_p")).drop("_v", "_z", "_p")
