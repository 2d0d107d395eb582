"""Tables, tests and metrics as grouped queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, null_safe_join
from ..functions.tails import Hypergeometric


def contingency(rows: DataFrame, by: str, high: str, inside: str) -> DataFrame:
    """Counts a, b, c, d: high in, high out, low in, low out."""
    h, i = F.coalesce(F.col(high), F.lit(False)), F.coalesce(F.col(inside), F.lit(False))
    return rows.groupBy(by).agg(F.count_if(h & i).alias("a"), F.count_if(h & ~i).alias("b"), F.count_if(~h & i).alias("c"), F.count_if(~h & ~i).alias("d"))


def haldane_or(tables: DataFrame) -> DataFrame:
    """Odds ratio (null with a zero cell below), its Haldane form and the 95 % Woolf interval."""
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    log, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    odds = F.col("a") * F.col("d") / F.nullif(F.col("b") * F.col("c"), F.lit(0))
    return tables.select("*", odds.alias("odds_ratio"), F.exp(log).alias("haldane_or"), F.exp(log - 1.96 * se).alias("ci_low"), F.exp(log + 1.96 * se).alias("ci_high"))


def fisher_or(tables: DataFrame, key: str) -> DataFrame:
    """Two-sided Fisher p of each table: the sum over its margins' tables that are no likelier. Exact for any counts; no table is listed."""
    a, b, c, d = (F.col(x) for x in "abcd")
    own = tables.select(key, "a", "b", "c", "d")
    return Hypergeometric(own, a + b + c + d, a + b, a + c).no_likelier(a, "fisher_p").select(key, "a", "b", "c", "d", "fisher_p")


def bh_fdr(df: DataFrame, p: str, key: str, cut_over: int = 100_000) -> DataFrame:
    """Benjamini-Hochberg q of the p-values; key breaks ties. Null p-values do not count and get a null q.

    Equal p-values are one row, whose last rank decides. One task orders up to cut_over distinct values, which are counted first; of more, ranks
    and the least p * n / rank of higher values run up by ranges of p (`run_up`), so no task orders all of them.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    down = lambda *by: Window.partitionBy(*by).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    if counts.limit(cut_over + 1).count() <= cut_over:
        rank = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
        q = counts.withColumn("_x", F.col("_p") * F.sum("_c").over(Window.partitionBy()) / rank).select("_p", F.least(F.min("_x").over(down()), F.lit(1.0)).alias("q"))
    else:
        ranked = run_up(counts, [], "_p", ["_c"], cut_over).withColumn("_rank", F.col("_c_under") + F.col("_c"))
        n = F.broadcast(counts.agg(F.sum("_c").alias("_n")))
        own = ranked.join(n, F.lit(True)).select("_p", "_b", (F.col("_p") * F.col("_n") / F.col("_rank")).alias("_x"))
        after = own.groupBy("_b").agg(F.min("_x").alias("_m")).withColumn("_later", F.min("_m").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)))
        least = F.least(F.min("_x").over(down("_b")), "_later", F.lit(1.0))
        q = own.join(F.broadcast(after.select("_b", "_later")), "_b").select("_p", least.alias("q"))
    return df.join(q, F.col(p) == F.col("_p"), "left").drop("_p")


def run_up(sums: DataFrame, by: list[str], value: str, cols: list[str], cut_over: int = 100_000, ranges: int = 256) -> DataFrame:
    """sums, one row a key and value, with <col>_under for each col: its sum over the key's smaller values; and _b, the range of the value.

    Sums run within one task for a key of up to cut_over values. The values of a larger one are cut in ranges by approximate quantiles; the
    sums run within a range, and the totals of the ranges before are added. So one key may hold most of the rows, or there may be no key.
    Values that are no numbers are not cut. A null key is a key. Whether a key is that large is asked first, by a job that counts values, as
    the plan with ranges reads the sums several times.
    """
    totals = [F.sum(c).alias(f"{c}_under") for c in cols]
    plain = dict(sums.dtypes)[value] in ("string", "binary", "boolean")
    if plain or sums.groupBy(*by).agg(F.count("*").alias("_many")).where(F.col("_many") > cut_over).isEmpty():
        marked = sums.withColumn("_b", F.lit(0)).withColumns({f"{c}_before": F.lit(0) for c in cols})
    else:
        points = [i / ranges for i in range(1, ranges)]
        cuts = sums.groupBy(*by).agg(F.count("*").alias("_many"), F.percentile_approx(value, points, 10_000).alias("_cuts")).where(F.col("_many") > cut_over).drop("_many")
        marked = null_safe_join(sums, cuts, by, "left").withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value)))))
        sizes = marked.where("_cuts is not null").groupBy(*by, "_b").agg(*totals)
        before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(*by, "_b", *[F.sum(f"{c}_under").over(before).alias(f"{c}_before") for c in cols])
        marked = null_safe_join(marked.drop("_cuts"), starts, [*by, "_b"], "left")
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    under = {f"{c}_under": F.coalesce(f"{c}_before", F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols}
    return marked.select("*", *[x.alias(n) for n, x in under.items()]).drop(*[f"{c}_before" for c in cols])


def average_rank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Mid-ranks: values counted, counts run up, joined back; so a value's ties are one row. Rows with a null value or key go."""
    return df.join(_ranks(df, value, by, out), [*by, value])


def _ranks(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return run_up(counts, by, value, ["_c"]).select(*by, value, (F.col("_c_under") + (F.col("_c") + 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str, by: list[str], min_n: int = 10) -> DataFrame:
    """Rank correlation of pairs that are complete; null under min_n pairs and where a side is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b2"))
    ranked = both.join(_ranks(both, "_a", by, "_ra"), [*by, "_a"]).join(_ranks(both, "_b2", by, "_rb"), [*by, "_b2"])
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= min_n, correlation("_ra", "_rb")).alias("rho"))


def auroc(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties halved, from weight sums by distinct score; null without both labels.

    The sums below a score run up by ranges of scores where a key has many, so one key may hold all rows. Rows with a null score go.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    known = df.where(F.col(score).isNotNull())
    sums = known.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col(y) == 0, w).otherwise(0.0)).alias("_n"))
    area = F.sum(F.col("_p") * (F.col("_n_under") + F.col("_n") / 2))
    return run_up(sums, by, score, ["_n"]).groupBy(*by).agg((area / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0.0))).alias("auroc"))


def average_precision(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Average precision, ties as one step, of rows of equal or given weight; null without positives. Sums run up by ranges from the highest score."""
    w = F.col(weight) if weight else F.lit(1)
    known = df.where(F.col(score).isNotNull()).withColumn("_down", -F.col(score))
    sums = known.groupBy(*by, "_down").agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("_p"), F.sum(w).alias("_n"))
    run = run_up(sums, by, "_down", ["_p", "_n"])
    tp, every = F.col("_p_under") + F.col("_p"), F.col("_n_under") + F.col("_n")
    return run.groupBy(*by).agg((F.sum(F.col("_p") * tp / every) / F.nullif(F.sum("_p"), F.lit(0))).alias("avg_precision"))


def class_metrics(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 at 0.5; 0 where undefined."""
    hit, true = F.col(score) >= 0.5, F.col(y) == 1
    got = df.groupBy(*by).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count("*").alias("n"), F.avg((hit == true).cast("double")).alias("accuracy"))
    part = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.select(*by, "n", "accuracy", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def reg_metrics(df: DataFrame, y: str, pred: str, by: list[str]) -> DataFrame:
    """Mean squared and absolute error, R2 (null for a constant y) and Pearson (null if a side is constant); rows with a null are left out by each average."""
    off = F.col(y) - F.col(pred)
    return df.groupBy(*by).agg(F.avg(off * off).alias("mse"), F.avg(F.abs(off)).alias("mae"), (1 - F.avg(off * off) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"), correlation(y, pred).alias("pearson"))


def group_sizes(df: DataFrame, block: str) -> DataFrame:
    """One row: number, least, largest and median size of the blocks, and the share of single ones; null is a block."""
    sizes = df.groupBy(block).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_groups"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.percentile("n", F.lit(0.5)).alias("median_size"), F.avg((F.col("n") == 1).cast("double")).alias("singleton_share"))


def percentile_ci(df: DataFrame, by: str, value: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Mean, sd (0 for one row), interval and n."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.percentile(value, F.lit(lo)).alias("lo"), F.percentile(value, F.lit(hi)).alias("hi"), F.count(value).alias("n"))


def icc_groups(df: DataFrame, y: str, group: str) -> DataFrame:
    """Between-group share of the sum of squares (eta squared), 1 if y is constant.

    Rows with a null label or group are left out; null with fewer than two groups.
    """
    known = df.where(F.col(y).isNotNull() & F.col(group).isNotNull())
    each = known.groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("m"))
    total = known.agg(F.avg(y).alias("all"), (F.var_pop(y) * F.count("*")).alias("ss"))
    got = each.join(F.broadcast(total), F.lit(True)).agg(F.sum(F.col("n") * (F.col("m") - F.col("all")) ** 2).alias("between"), F.max("ss").alias("ss"), F.count("*").alias("groups"))
    share = F.when(F.col("ss") <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("between") / F.col("ss"))))
    return got.select(F.when(F.col("groups") > 1, share).alias("eta_squared"))


def purity(df: DataFrame, y: str, block: str) -> DataFrame:
    """Majority-label share of each block and its labelled rows; null labels do not count."""
    counts = df.where(F.col(y).isNotNull()).groupBy(block, y).agg(F.count("*").alias("n"))
    return counts.groupBy(block).agg((F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("n"))


def mean_pool(vectors: DataFrame, key: str, features: str = "features") -> DataFrame:
    """Mean of a key's vectors, by position."""
    got = vectors.select(key, F.posexplode(features).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return got.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("pooled"))


def group_macro(pred: DataFrame, group: str, y: str, p: str) -> DataFrame:
    """Mean label and mean prediction of each group."""
    return pred.groupBy(group).agg(F.avg(y).alias("mean_y"), F.avg(p).alias("mean_pred"))


def overlap_audit(a: DataFrame, b: DataFrame, id_col: str, block_col: str, cap: int = 50) -> DataFrame:
    """One row: sizes, shared ids and blocks, their shares of b, and the first shared ids."""
    ids = a.select(id_col).intersect(b.select(id_col)).agg(F.count("*").alias("shared_ids"), F.slice(F.array_sort(F.collect_set(id_col)), 1, cap).alias("first_shared"))
    blocks = a.select(block_col).intersect(b.select(block_col)).agg(F.count("*").alias("shared_blocks"))
    sizes = a.agg(F.count("*").alias("n_a"), F.count_distinct(id_col).alias("ids_a")).join(b.agg(F.count("*").alias("n_b"), F.count_distinct(id_col).alias("ids_b"), F.count_distinct(block_col).alias("blocks_b")), F.lit(True))
    got = sizes.join(ids, F.lit(True)).join(blocks, F.lit(True))
    return got.select("*", (F.col("shared_ids") / F.nullif(F.col("ids_b"), F.lit(0))).alias("share_ids"), (F.col("shared_blocks") / F.nullif(F.col("blocks_b"), F.lit(0))).alias("share_blocks"))


def content_overlap(a: DataFrame, b: DataFrame, id_col: str, text: str) -> DataFrame:
    """(digest, id_a, id_b, n_a, n_b) for each content that both splits hold: the least ids and how many rows have it.

    The rows themselves come by joining their digest; copies are not paired off. Null texts are no content.
    """
    digests = lambda df, side: df.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("digest")).agg(F.min(id_col).alias(f"id_{side}"), F.count("*").alias(f"n_{side}"))
    return digests(a, "a").join(digests(b, "b"), "digest").select("digest", "id_a", "id_b", "n_a", "n_b")
