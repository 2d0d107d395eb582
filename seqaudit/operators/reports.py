"""Composite audits: repeated split contrasts, influence of groups, baselines, adjusted logistic fits, locus scores, leakage."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import draw
from . import controls, draws, intervals, logits, panels, statistics
from .probes import ALPHAS, _square, fitted, moment_table, moments, oof_ridge, pick_alpha, probe_gap, scored
from .rows import finite, finite_rows
from .splits import hash_rank, kfold_random


def locked_alpha(df: DataFrame, features: str, y: str, group: str, k: int = 5, alphas=ALPHAS) -> float:
    """The ridge penalty of least squared error over folds of whole groups, chosen once for all that follows."""
    return pick_alpha(moments(df.withColumn("_fold", group_fold(group, k)), features, y, "_fold"), alphas)


def group_fold(group: str, k: int, seed: int = 42) -> Column:
    """Fold of a row by its group's hash: no pass over the groups, and whole groups fall in one fold."""
    return (draw(seed, F.col(group)) % k).cast("int")


def _scores(pred: DataFrame, by: list[str], group: str, binary: bool) -> DataFrame:
    """(by, score, macro): over rows, and over groups that count alike. AUROC for a binary label, else rank correlation."""
    if binary:
        weight = F.lit(1.0) / F.count("*").over(Window.partitionBy(*by, group))
        each = statistics.auroc(pred, "y", "pred", by).withColumnRenamed("auroc", "score")
        macro = statistics.auroc(pred.withColumn("_w", weight), "y", "pred", by, "_w").withColumnRenamed("auroc", "macro")
    else:
        each = statistics.spearman(pred, "y", "pred", by).select(*by, F.col("rho").alias("score"))
        means = pred.groupBy(*by, group).agg(F.avg("y").alias("y"), F.avg("pred").alias("pred"))
        macro = statistics.spearman(means, "y", "pred", by, min_n=3).select(*by, F.col("rho").alias("macro"))
    return each.join(macro, by, "left")


def _is_binary(df: DataFrame, y: str) -> bool:
    return df.select(y).where(F.col(y).isNotNull()).distinct().limit(3).count() == 2


def split_contrast(df: DataFrame, id_col: str, features: str, y: str, group: str, repeats: int = 20, k: int = 5, alpha: float | None = None, seed: int = 42) -> DataFrame:
    """(metric, mean, sd, lo, hi, n) over repeats of random against blocked folds, at one penalty.

    Metrics are random, blocked and delta of the score over rows and, with _macro, over groups. All repeats are dealt in one table:
    a row comes once for each repeat and scheme, its fold by hash of the row or of its group; one pass gathers the moments of all of
    them, one scores. Rows with a label or feature that is not finite go.
    """
    kept = finite_rows(df, y, features).select(F.col(id_col).alias("id"), F.col(features).alias("features"), F.col(y).cast("double").alias("y"), F.col(group).alias("grp")).where("grp is not null")
    alpha = locked_alpha(kept, "features", "y", "grp", k) if alpha is None else alpha
    each = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    by_row, by_group = (draw(F.col("rep") + seed + 1000, F.col("id")) % k), (draw(F.col("rep") + seed, F.col("grp")) % k)
    both = each.select("*", F.explode(F.array(F.struct(F.lit("random").alias("scheme"), (F.col("rep") * 2 * k + by_row).cast("int").alias("code")), F.struct(F.lit("blocked").alias("scheme"), (F.col("rep") * 2 * k + k + by_group).cast("int").alias("code")))).alias("s")).select("id", "features", "y", "grp", "rep", "s.scheme", "s.code")
    grams = moments(both, "features", "y", "code")
    of = lambda code: code // k  # noqa: E731  folds of one repeat and scheme follow each other
    lines = []
    for code, own in grams.items():
        rest = [g for c, g in grams.items() if of(c) == of(code) and c != code]
        if rest:
            lines.append((code, *fitted(sum(rest), alpha)))
    pred = scored(both, "features", "code", lines).select("rep", "scheme", "grp", "y", "pred").where("pred is not null")
    got = _scores(pred, ["rep", "scheme"], "grp", _is_binary(kept, "y"))
    wide = got.groupBy("rep").pivot("scheme", ["random", "blocked"]).agg(F.first("score").alias("score"), F.first("macro").alias("macro"))
    values = [("random", F.col("random_score")), ("blocked", F.col("blocked_score")), ("delta", F.col("random_score") - F.col("blocked_score")), ("random_macro", F.col("random_macro")), ("blocked_macro", F.col("blocked_macro")), ("delta_macro", F.col("random_macro") - F.col("blocked_macro"))]
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values])).alias("m")).select("m.metric", "m.value").where("value is not null")
    return statistics.percentile_ci(long, "metric", "value")


def logo_influence(df: DataFrame, id_col: str, features: str, y: str, group: str, alpha: float | None = None, min_train: int = 5) -> DataFrame:
    """(group, n_test, status, rho_within, score_without, delta) with every group held out in turn.

    A line is fitted for each group on the executors, from all moments less the group's own, and joined to the group's rows.
    score_without is the score of all held-out predictions less the group's own (`_score_without`), delta its difference from the score with it.
    Null where a side is constant.
    """
    kept = finite_rows(df, y, features).select(F.col(id_col).alias("id"), F.col(features).alias("features"), F.col(y).cast("double").alias("y"), F.col(group).alias("grp")).where("grp is not null")
    alpha = locked_alpha(kept, "features", "y", "grp") if alpha is None else alpha
    grams = moment_table(kept, "features", "y", "grp")
    summed = grams.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # (d + 2)^2 numbers
    total = _square([r["x"] for r in sorted(summed, key=lambda r: r["i"])]) if summed else None

    def solve(batches):
        for batch in batches:
            rest = [total - _square(m) for m in batch.column("m").to_pylist()]
            lines = [fitted(m, alpha) if m[0, 0] >= min_train else (None, None) for m in rest]
            yield pa.record_batch([batch.column("key"), pa.array([b for b, _ in lines], pa.float64()), pa.array([w for _, w in lines], pa.list_(pa.float64()))], names=["grp", "_b", "_w"])

    lines = grams.mapInArrow(solve, f"grp {kept.schema['grp'].dataType.simpleString()}, _b double, _w array<double>")
    dot = F.aggregate(F.zip_with("features", "_w", lambda x, w: x.cast("double") * w), F.col("_b"), lambda s, x: s + x)
    pred = kept.join(lines.where("_b is not null"), "grp").select("grp", "y", dot.alias("pred"))
    score = _score_without(pred, _is_binary(kept, "y"))
    inside = statistics.spearman(pred, "y", "pred", ["grp"], min_n=3).select("grp", F.col("rho").alias("rho_within"))
    sizes = kept.groupBy("grp").agg(F.count("*").alias("n_test"))
    got = sizes.join(lines.select("grp", F.when(F.col("_b").isNull(), "too_small").otherwise("ok").alias("status")), "grp").join(inside, "grp", "left").join(score, "grp", "left")
    return got.select(F.col("grp").alias("group"), "n_test", "status", "rho_within", "score_without", (F.col("score_without") - F.col("full")).alias("delta"))


def _score_without(pred: DataFrame, binary: bool) -> DataFrame:
    """(grp, score_without, full) of rows (grp, y, pred): the score of the rows of the other groups, and of all.

    AUROC of a binary label: of all pairs of a positive and a negative, those that touch the group are taken off by its sums against
    all rows and within itself, so rows are never repeated. The rank correlation of another label has no such sums, as leaving a group
    out moves the ranks of the others: each row comes once for each other group there, rows times groups.
    """
    if binary:
        p, n = (F.sum((F.col("y") == v).cast("double")) for v in (1, 0))
        top = pred.groupBy().agg(F.max("y").alias("_top"))  # a binary label need not be 0 and 1
        marked = pred.join(F.broadcast(top), F.lit(True)).select("grp", "pred", (F.col("y") == F.col("_top")).cast("int").alias("y"))
        every = statistics.run_up(marked.groupBy("pred").agg(p.alias("p"), n.alias("n")), [], "pred", ["p", "n"])
        own = statistics.run_up(marked.groupBy("grp", "pred").agg(p.alias("gp"), n.alias("gn")), ["grp"], "pred", ["gn"])
        half = F.col("n_under") + F.col("n") / 2
        total = every.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("p") * half).alias("U"))
        met = own.join(every.select("pred", half.alias("below"), (F.col("p_under") + F.col("p") / 2).alias("under_p")), "pred")
        sums = met.groupBy("grp").agg(F.sum("gp").alias("gp"), F.sum("gn").alias("gn"), F.sum(F.col("gp") * F.col("below")).alias("x"), F.sum(F.col("gn") * F.col("under_p")).alias("z"), F.sum(F.col("gp") * (F.col("gn_under") + F.col("gn") / 2)).alias("w"))
        rest = F.col("U") - F.col("x") - (F.col("gn") * F.col("P") - F.col("z")) + F.col("w")
        score = F.try_divide(rest, (F.col("P") - F.col("gp")) * (F.col("N") - F.col("gn")))
        return sums.join(F.broadcast(total), F.lit(True)).select("grp", score.alias("score_without"), F.try_divide(F.col("U"), F.col("P") * F.col("N")).alias("full"))
    groups = hash_rank(pred.select("grp").distinct(), "grp", 42, "code")
    n = groups.count()
    others = pred.join(groups, "grp").select("y", "pred", "code", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("out")).where("out <> code")
    rho = statistics.spearman(others, "y", "pred", ["out"]).select(F.col("out").alias("code"), F.col("rho").alias("score_without"))
    full = statistics.spearman(pred, "y", "pred", []).select(F.col("rho").alias("full"))
    return groups.join(rho, "code", "left").join(F.broadcast(full), F.lit(True)).select("grp", "score_without", "full")


def audit_report(df: DataFrame, id_col: str, label: str, group: str, block: str, features: str | None = None, other: DataFrame | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """One row, the report card of a manifest: geometry, overlap with another split if given, and the probe's gap if there are features."""
    out = df.agg(F.count("*").alias("n_rows")).join(panels.geometry_report(df, id_col, label, group, block), F.lit(True))
    if other is not None:
        out = out.join(statistics.overlap_audit(df, other, id_col, block), F.lit(True))
    if features:
        dealt = kfold_random(df, id_col, k, seed).withColumnRenamed("fold", "_random").withColumn("_blocked", group_fold(block, k, seed))
        out = out.join(probe_gap(dealt, id_col, features, label, "_random", "_blocked"), F.lit(True), "left")
    n = F.col("n_groups")
    return out.withColumn("warnings", F.array_compact(F.array(F.when(F.col("singleton_share") == 1, "ALL_SINGLETON_GROUPS"), F.when(n < 10, "FEW_GROUPS"))))


def baseline_matrix(df: DataFrame, id_col: str, feature_sets: dict[str, str], targets: list[str], schemes: dict[str, str]) -> DataFrame:
    """(features, target, scheme, n, rho): the same ridge probe over every combination; feature sets and schemes name columns.

    The columns are kept while the combinations read them, as each reads them several times; the driver gets a row of each.
    """
    kept = df.select(*dict.fromkeys([id_col, *feature_sets.values(), *targets, *schemes.values()])).persist()
    out = []
    for name, features in feature_sets.items():
        for y in targets:
            for scheme, fold in schemes.items():
                pred = oof_ridge(kept, id_col, features, y, fold).select(F.lit(1).alias("_all"), "y", "pred")
                out += [(name, y, scheme, r["n"], r["rho"]) for r in statistics.spearman(pred, "y", "pred", ["_all"]).collect()]
    kept.unpersist()
    return df.sparkSession.createDataFrame(out, "features string, target string, scheme string, n bigint, rho double")


def logit_adjust(windows: DataFrame, high: str, exposure: str, covariates: list[str], group: str, folds: int = 5, min_train: int = 5) -> DataFrame:
    """(model, coefficient, odds_ratio, auroc, logo_auroc, covariates_logo_auroc): logistic coefficient of a 0/1 exposure for a 0/1 `high`, crude and with covariates.

    Covariates are standardised; the penalty is half the squared norm over the rows (C = 1). logo_auroc is that of rows scored by the model fitted to all other
    groups, one fit a group, with covariates standardised over these (`leave_out_lines`); covariates_logo_auroc, the published figure, that of the covariates without the
    exposure. Groups whose others are under min_train rows or of one label are not scored; null if under 6 rows are. auroc is a further figure, of models that leave
    whole groups out by folds. Rows with a null or a number that is not finite go. Rows are counted by group and values once, so the fits read these counts.
    """
    own = [f"c{i}" for i, _ in enumerate(covariates)]
    numbers = ["label", "e", *own]
    rows = windows.select(F.col(group).alias("grp"), *[F.col(c).cast("double").alias(n) for n, c in zip(numbers, [high, exposure, *covariates], strict=True)]).where("grp is not null")
    counts = logits.settled(rows.where(functools.reduce(Column.__and__, [finite(F.col(n)) for n in numbers])).groupBy("grp", *numbers).agg(F.count("*").cast("double").alias("w")))
    n, high_n, *sums = counts.agg(F.sum("w"), F.sum(F.col("w") * F.col("label")), *[F.sum(F.col("w") * F.col(c)) for c in own]).first()
    out = []
    if n and 0 < high_n < n:
        mean = [x / n for x in sums]
        square = counts.agg(F.sum("w"), *[F.sum(F.col("w") * (F.col(c) - m) ** 2) for c, m in zip(own, mean, strict=True)]).first()[1:]
        sd = [math.sqrt(q / n) for q in square]
        sd = [s if s > 1e-12 * abs(m) else 1.0 for s, m in zip(sd, mean, strict=True)]
        z = [(F.col(c) - m) / s for c, m, s in zip(own, mean, sd, strict=True)]
        names = ["crude", "adjusted", *(["covariates"] if own else [])]
        free = [[True, name != "covariates", *[name != "crude"] * len(own)] for name in names]
        cells = counts.select("grp", group_fold("grp", folds).alias("fold"), "label", F.array(F.lit(1.0), "e", *z).alias("x"), "w")
        lines = logits.leave_out_lines(cells, [q / s**2 for q, s in zip(square, sd, strict=True)], free, min_train)
        whole = {names[r["model"]]: r["b"][1] for r in lines.where("times = 0 and fold = -1").collect()}
        scores = logits.left_out_scores(lines, cells, len(free[0]))
        sizes = {(r["out"], r["model"]): r["n"] for r in scores.groupBy("out", "model").agg(F.sum("weight").alias("n")).collect()}
        areas = {(r["out"], names[r["model"]]): r["auroc"] for r in statistics.auroc(scores, "label", "score", ["out", "model"], "weight").collect() if r["out"] == "fold" or sizes[r["out"], r["model"]] > 5}
        out = [(name, whole[name], math.exp(whole[name]), areas.get(("fold", name)), areas.get(("group", name)), areas.get(("group", "covariates")) if name == "adjusted" else None) for name in ("crude", "adjusted")]
    return windows.sparkSession.createDataFrame(out, "model string, coefficient double, odds_ratio double, auroc double, logo_auroc double, covariates_logo_auroc double")


def locus_set_null(track: DataFrame, loci: DataFrame, b_outer: int, b_inner: int, key: str = "accession", seed: int = 42, genomes: DataFrame | None = None) -> DataFrame:
    """One row: Stouffer T of the loci's circular-shift z, and its p against random loci of the same lengths.

    loci has one [s0, s1) a key. For outer permutation 0 the locus itself, else one at a random start, is compared with b_inner shifts of
    the track; T sums the z over the keys. A genome is one row that makes its draws in numpy and looks masses up in prefix sums. A track may have
    gaps; genomes (key, n) gives lengths, else a genome ends with its last position.
    """
    rows = draws.genome_rows(track, loci.withColumn("cls", F.lit("")), genomes or intervals.track_lengths(track, key), key, "cls")
    fit = rows.where((F.col("spans")[0]["len"] > 0) & (F.col("n") > F.col("spans")[0]["len"] + 1))
    z = draws.locus_z(fit, b_outer, b_inner, seed)
    t = z.select("outer", "n", F.round(F.col("z") / F.sqrt("n"), 4).alias("t"))
    # n is the same in all b_outer + 1 rows; a window reads them once, where a join would make all draws again
    seen = t.withColumn("t_observed", F.max(F.when(F.col("outer") == 0, F.col("t"))).over(Window.partitionBy("n")))
    return seen.where("outer > 0").groupBy("n", "t_observed").agg(((1 + F.count_if(F.col("t") >= F.col("t_observed"))) / (1 + F.count("*"))).alias("p"), F.avg("t").alias("null_mean"), F.percentile("t", F.lit(0.95)).alias("null_p95"))


def known_locus_scores(track: DataFrame, loci: DataFrame, b: int, key: str = "accession", cls: str = "cls", seed: int = 42) -> DataFrame:
    """Of each named locus (cls) of each key: mean absolute score, percentile among tiles, enrichment and circular-shift p."""
    tiles = controls.locus_percentile(loci, track, key, cls)
    mass = intervals.mass_enrichment(track, loci, key, cls)
    null = intervals.shift_null(track, loci, b, key, cls, seed).select(key, cls, "p")
    return tiles.join(mass, [key, cls]).join(null, [key, cls])


def known_locus_summary(scores: DataFrame, families: DataFrame, key: str = "accession", cls: str = "cls", alpha: float = 0.05, high: float = 0.9) -> DataFrame:
    """Of each locus in each family: genomes, median and mean enrichment, median percentile, and how many have a p under alpha or a percentile of `high` or more."""
    met = scores.join(families.select(key, "family").distinct(), key)
    sure = F.count_if(F.col("p") < alpha)
    return met.groupBy("family", cls).agg(
        F.count_distinct(key).alias("n_accessions"),
        F.percentile("enrichment", F.lit(0.5)).alias("median_enrichment"),
        F.avg("enrichment").alias("mean_enrichment"),
        F.percentile("percentile", F.lit(0.5)).alias("median_percentile"),
        sure.alias("n_significant"),
        (sure / F.count("*")).alias("frac_significant"),
        F.count_if(F.col("percentile") >= high).alias("n_high"),
    )


#: A prime under 2 ** 31: hash i of a k-mer is (u + i * v) modulo it, u and v from the k-mer's md5.
PRIME = 2_147_483_647


def minhashes(df: DataFrame, id_col: str, text: Column, names: tuple[str, str], k: int = 7, stride: int = 31, hashes: int = 128) -> DataFrame:
    """(id, hashes): the least hash of a text's k-mers, one every stride letters, under each of so many hash functions; no row under k letters."""
    prime, turn = np.int64(PRIME), np.arange(1, hashes + 1, dtype=np.int64)[:, None]

    def least(batches):
        for batch in batches:
            out = []
            for x in batch.column("x").to_pylist():
                mers = {x[i : i + k] for i in range(0, len(x) - k + 1, stride)}
                words = np.frombuffer(b"".join(hashlib.md5(m.encode()).digest()[:8] for m in mers), ">u4").astype(np.int64).reshape(-1, 2) % prime
                own = np.full(hashes, prime)
                for low in range(0, len(words), 4096):
                    part = words[low : low + 4096]
                    own = np.minimum(own, ((part[:, 0] + turn * part[:, 1]) % prime).min(axis=1))
                out.append(own)
            yield pa.record_batch([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], names=list(names))

    rows = df.select(F.col(id_col).alias("id"), text.alias("x")).where(F.length("x") >= k)
    return rows.mapInArrow(least, f"{names[0]} {df.schema[id_col].dataType.simpleString()}, {names[1]} array<bigint>")


def minhash_leakage(a: DataFrame, b: DataFrame, id_col: str, seq: str, k: int = 7, stride: int = 31, hashes: int = 128, rows: int = 8, least: float = 0.5, salts: int = 32, often: int = 1000) -> DataFrame:
    """(id_b, id_a, agreement): for rows of b, the row of a whose min-hashes agree most, at `least` or more; the least id on ties. Ids of any type.

    Candidates share a band of `rows` hashes; agreement is the share of all hashes. Texts of one signature stand for one another, the least
    id for all of a, and a signature is compared once for all its rows of b, so copies do not multiply pairs. A band value that over
    `often` signatures of a hold is dealt over `salts` tasks: each takes its part of a, and b's signatures go to all. Null texts and those under k letters meet nothing.
    """
    signed = lambda df, side: minhashes(df, id_col, F.upper(seq), (f"id_{side}", f"m_{side}"), k, stride, hashes)
    bands = lambda m: F.transform(F.sequence(F.lit(0), F.lit(hashes // rows - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(m, i * rows + 1, rows)).alias("value")))
    x = signed(a, "a").groupBy("m_a").agg(F.min("id_a").alias("id_a"))
    y = signed(b, "b")
    left = x.select("id_a", "m_a", F.inline(bands(F.col("m_a"))))
    right = y.select("m_b").distinct().select("m_b", F.inline(bands(F.col("m_b"))))
    hot = left.groupBy("band", "value").count().where(F.col("count") > often).select("band", "value", F.lit(True).alias("hot"))
    dealt = lambda df, salt: df.join(hot, ["band", "value"], "left").withColumn("salt", salt)
    left = dealt(left, F.when(F.col("hot"), F.pmod(F.xxhash64("id_a"), F.lit(salts)).cast("int")).otherwise(0)).drop("hot")
    right = dealt(right, F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    same = F.aggregate(F.zip_with("m_a", "m_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / hashes
    met = left.join(right, ["band", "value", "salt"]).select("id_a", "m_b", same.alias("agreement")).where(F.col("agreement") >= least)
    best = met.groupBy("m_b").agg(F.min_by(F.struct("id_a", "agreement"), F.struct(-F.col("agreement"), F.col("id_a"))).alias("x"))
    return y.join(best, "m_b").select("id_b", "x.id_a", "x.agreement")


def clean_manifest(dev: DataFrame, held: DataFrame, id_col: str, seq: str, threshold: float = 0.95) -> DataFrame:
    """Rows of dev without the ids, the contents and, by min-hash agreement of threshold or more, the near-duplicates of the held-out rows."""
    near = minhash_leakage(held, dev, id_col, seq, least=threshold).select(F.col("id_b").alias(id_col)).distinct()
    return panels.clean_manifest(dev, held, id_col, seq).join(near, id_col, "left_anti")
