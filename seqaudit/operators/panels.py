"""Classes, panels, pivots, holdouts and reports."""

from __future__ import annotations

import functools
import itertools
import operator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join
from ..functions.keyed import draw
from . import rows, splits, statistics


#: Classes of features in order of precedence, with the whole names, parts of names and patterns of names that tell them.
CLASSES = [
    ("rbd", [], ["rbd", "receptor bind"], []),
    ("entry_interface", ["s", "he", "spike"], ["spike", "surface glycoprotein", "receptor bind", "rbd", "hemagglutinin-esterase", "s glycoprotein"], []),
    ("polymerase_replicase", ["orf1ab", "orf1a", "orf1b", "1a", "1ab", "1b"], ["orf1", "polyprotein", "replicase", "rna-dependent rna polymerase", "rdrp", "helicase", "nsp", "methyltransferase", "exonuclease", "endorna"], []),
    ("accessory_immune", [], ["orf3", "orf6", "orf7", "orf8", "orf10", "accessory", "interferon", "immune", "ns3", "ns7"], ["(orf)?([3-9]|10)a?", r"ns\d+"]),
    ("structural_other", ["e", "m", "n"], ["envelope", "membrane", "nucleocapsid", "nucleoprotein"], []),
]


def classify_span(spans: DataFrame, names: tuple[str, ...] = ("gene", "product", "label"), out: str = "cls") -> DataFrame:
    """The first of CLASSES that a name of the span tells: whole, in part, or by pattern; null without one. Null and empty names tell nothing."""
    every = F.filter(F.array(*[F.lower(F.col(c)) for c in names]), lambda x: F.coalesce(x != "", F.lit(False)))
    tests = []
    for cls, whole, parts, patterns in CLASSES:
        fits = lambda x: functools.reduce(operator.or_, [x.isin(*whole)] * bool(whole) + [x.contains(p) for p in parts] + [x.rlike(f"^(?:{p})$") for p in patterns])  # noqa: B023, E731
        tests.append(F.when(F.exists(every, fits), cls))
    return spans.withColumn(out, F.coalesce(*tests))


def class_spans(spans: DataFrame, names: tuple[str, ...] = ("gene", "product", "label"), out: str = "cls") -> DataFrame:
    """A row for each class that a span counts in: its own, and entry_interface too for one of rbd. Spans without a class have none."""
    own = classify_span(spans, names, out)
    return own.withColumn(out, F.explode(F.when(F.col(out) == "rbd", F.array(F.lit("rbd"), F.lit("entry_interface"))).when(F.col(out).isNotNull(), F.array(out))))


def classify_feature(df: DataFrame, label: str, rules: list[tuple[str, str]], out: str = "cls") -> DataFrame:
    """The class of the first rule (class, pattern) whose pattern is in the label; null without one. classify_span has built-in rules."""
    return df.withColumn(out, F.coalesce(*[F.when(F.col(label).rlike(f"(?i){p}"), c) for c, p in rules]))


def prefix_override(spans: DataFrame, genomes: DataFrame, rules: list[tuple[str, int, int, list[str]]], key: str = "accession") -> DataFrame:
    """Spans and, for genomes whose key starts with a rule's prefix, its constant span in each of its classes."""
    for prefix, s0, s1, classes in rules:
        own = genomes.where(F.col(key).cast("string").startswith(prefix)).select(key, F.explode(F.array(*map(F.lit, classes))).alias("cls"), F.lit(s0).alias("s0"), F.lit(s1).alias("s1"))
        spans = spans.select(key, "cls", "s0", "s1").unionByName(own)
    return spans


def concordance(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """For the top windows of two models: is each column the same, by key. Two nulls are the same."""
    both = a.select(key, *[F.col(c).alias(f"{c}_a") for c in cols]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in cols]), key)
    return both.select("*", *[F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")).alias(f"same_{c}") for c in cols])


def agreement(both: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the number of keys of a concordance and the share of them that agree in each column."""
    return both.agg(F.count("*").alias("n"), *[F.avg(F.col(f"same_{c}").cast("double")).alias(f"share_{c}") for c in cols])


def resolve_locus(genomes: DataFrame, spans: DataFrame, last_third: DataFrame, frac: float = 0.7, key: str = "accession") -> DataFrame:
    """(key, s0, s1, span_source): the annotated span, else one told from the last third, else the first part of the genome.

    The part is a decimal, as 90 * 0.7 is under 63 in doubles.
    """
    own = spans.groupBy(key).agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"))
    third = last_third.select(key, (F.col("s1") - 3 * (F.col("s1") - F.col("s0"))).alias("t0"), F.col("s1").alias("t1"))
    got = genomes.join(own, key, "left").join(third, key, "left")
    pick = lambda x, y, z: F.coalesce(x, y, z).cast("bigint")
    source = F.when(F.col("s0").isNotNull(), "annotated").when(F.col("t0").isNotNull(), "last_third").otherwise("default")
    return got.select(key, pick(F.col("s0"), F.col("t0"), F.lit(0)).alias("s0"), pick(F.col("s1"), F.col("t1"), F.floor(F.col("n") * F.lit(Decimal(str(frac))))).alias("s1"), source.alias("span_source"))


def pooled_enrichment(per: DataFrame, by: str, value: str, p: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Number, median and mean of a value by class and, given p-values, their median and how many lie under alpha; nulls are left out."""
    more = [F.percentile(p, F.lit(0.5)).alias("median_p"), F.count_if(F.col(p) < alpha).alias("n_significant")] if p else []
    return per.groupBy(by).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), *more)


def high_low(windows: DataFrame, key: str, high: str, value: str) -> DataFrame:
    """Mean of a value in the high and the low windows of each key, and their difference."""
    top, low = F.avg(F.when(F.col(high), F.col(value))), F.avg(F.when(~F.col(high), F.col(value)))
    return windows.groupBy(key).agg(top.alias("high"), low.alias("low"), (top - low).alias("delta"))


def class_counts(windows: DataFrame, key: str, cls: str) -> DataFrame:
    """The map class -> count of each key, as text in class order."""
    counts = windows.groupBy(key, cls).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", cls, "n"))), ",").alias("counts"))


def dense_track(track: DataFrame, key: str = "accession", order: str | None = None) -> DataFrame:
    """A row for every position up to a track's last one, 0 where none was given.

    Of a position given twice the last one by `order` wins (the highest score without an order).
    """
    one = track.groupBy(key, "pos").agg(F.max_by("attr", order or "attr").alias("attr"))
    full = track.groupBy(key).agg(F.max("pos").alias("last")).select(key, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pos"))
    return full.join(one, [key, "pos"], "left").withColumn("attr", F.coalesce("attr", F.lit(0.0)))


def anchor_starts(seqs: DataFrame, length: str, window_len: int, k: int) -> DataFrame:
    """k evenly spaced starts, halves rounded to even."""
    room = F.greatest(F.col(length) - window_len, F.lit(0))
    got = seqs.withColumn("anchor", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return got.withColumn("start", F.bround(F.col("anchor") / max(1, k - 1) * room, 0).cast("int"))


def cap_windows(windows: DataFrame, key: str, m: int, order: str = "start") -> DataFrame:
    """At most m windows of each key, at evenly spaced places."""
    got = windows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    places = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / max(1, m - 1)))
    return got.where((F.col("_n") <= m) | F.array_contains(places, F.col("_i").cast("bigint"))).drop("_i", "_n")


def third_locus(spans: DataFrame, names: tuple[str, str, str] = ("proximal", "middle", "distal")) -> DataFrame:
    """The three thirds of each span."""
    cut = lambda i: F.col("s0") + F.floor((F.col("s1") - F.col("s0")) * i / 3).cast("int")
    thirds = F.array(*[F.struct(F.lit(c).alias("locus"), cut(i).alias("l0"), cut(i + 1).alias("l1")) for i, c in enumerate(names)])
    return spans.select("*", F.inline(thirds))


def expand_panel(df: DataFrame, panel: DataFrame, key: str, group: str, length: str, n: int = 40) -> DataFrame:
    """The panel and, of groups that it lacks, the longest row, the first n rows in all by source and key."""
    order = Window.partitionBy(group).orderBy(F.desc(length), key)
    own = df.join(panel.select(key), key, "left_semi")
    more = df.join(own.select(group).distinct(), group, "left_anti").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    both = own.withColumn("added", F.lit(0)).unionByName(more.withColumn("added", F.lit(1)))
    return both.orderBy("added", key).limit(n)


def one_hot(df: DataFrame, col: str, values: list, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each value (all but the first with drop_first); null is 0 in all."""
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in values[int(drop_first) :]])


def hot(df: DataFrame, col: str, most: int = 1000) -> Column:
    """0/1 doubles for the values of a column in order, a null having none; an error for more than `most` values, as a row holds them all."""
    values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{col} has over {most} values")
    return F.array(*[F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)) for v in values])


def kmer_vectors(df: DataFrame, key: str, seq: str, k: int = 3) -> DataFrame:
    """(key, kmers): the frequencies of all k-mers of A, C, G and T in order, 0 for texts under k letters."""
    names = ["".join(x) for x in itertools.product("ACGT", repeat=k)]
    freqs = rows.kmer_counts(df, key, seq, k).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "freq"))).alias("_f"))
    found = F.transform(F.array(*map(F.lit, names)), lambda m: F.coalesce(F.try_element_at("_f", m), F.lit(0.0)))
    return df.select(key).distinct().join(freqs, key, "left").select(key, F.coalesce(found, F.array_repeat(F.lit(0.0), len(names))).alias("kmers"))


def cosine_within(vectors: DataFrame, cluster: str, features: str = "features") -> DataFrame:
    """Mean cosine of all pairs within each cluster, without making pairs: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    norm = F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    each = vectors.select(cluster, norm.alias("_l"), features).where("_l > 0")
    sums = each.select(cluster, "_l", F.posexplode(features).alias("i", "x")).groupBy(cluster, "i").agg(F.sum(F.col("x") / F.col("_l")).alias("s"), F.count("*").alias("n"))
    return sums.groupBy(cluster).agg(F.max("n").alias("n"), F.when(F.max("n") > 1, (F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).alias("cosine"))


def cosine_pairs(vectors: DataFrame, id_col: str, cluster: str, features: str = "features", lags: int = 3, between_ratio: int = 3, buckets: int = 64, seed: int = 42) -> DataFrame:
    """(kind, n, mean, q1, median, q3) of cosines within and between clusters, over pairs drawn by keyed hashing.

    Vectors are dealt in buckets by hash and ordered by it; each meets the `lags` before it of its bucket and cluster, and those of other
    clusters among the lags * between_ratio before it in its bucket. So the pairs grow with the vectors, not their square; choose buckets so
    that one fits a task. Null and zero vectors go; a null cluster is one.
    """
    norm = F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    h = draw(seed, F.col(id_col))
    own = vectors.select(F.col(id_col).alias("id"), F.col(cluster).alias("c"), h.alias("h"), (h % buckets).alias("b"), norm.alias("l"), features).where("l > 0")
    own = own.select("id", "c", "h", "b", F.transform(features, lambda x: x.cast("double") / F.col("l")).alias("u"))
    dot = lambda v: F.aggregate(F.zip_with("u", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    same, near = Window.partitionBy("b", "c").orderBy("h", "id"), Window.partitionBy("b").orderBy("h", "id")
    inside = [F.struct(F.lit("within").alias("kind"), dot(F.lag("u", j).over(same)).alias("x")) for j in range(1, lags + 1)]
    across = [F.struct(F.lit("between").alias("kind"), F.when(~F.lag("c", j).over(near).eqNullSafe(F.col("c")), dot(F.lag("u", j).over(near))).alias("x")) for j in range(1, lags * between_ratio + 1)]
    pairs = own.select(F.array(*inside, *across).alias("ps")).select(F.explode("ps").alias("p")).select("p.kind", F.round("p.x", 6).alias("x")).where("x is not null")
    return pairs.groupBy("kind").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), *[F.percentile("x", F.lit(q)).alias(c) for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


def kmer_enrichment(counts: DataFrame, high: Column, stratum: list[str] | None = None) -> DataFrame:
    """Of each k-mer in each stratum: high and low counts, log2 of the ratio of its shares and its odds ratio (0.5 added), Fisher p and q.

    q is Benjamini-Hochberg over all rows. counts has (kmer, n) and what high and stratum name. Its sums, a row for each k-mer and stratum, are kept,
    as totals, tests and q each read them.
    """
    by = list(stratum or [])
    got = counts.groupBy(*by, "kmer").agg(F.sum(F.when(high, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(high, 0).otherwise(F.col("n"))).alias("c")).persist()
    total = got.groupBy(*by).agg(F.sum("a").alias("_a"), F.sum("c").alias("_c"))
    tables = (got.join(total, by) if by else got.join(F.broadcast(total), F.lit(True))).withColumn("b", F.col("_a") - F.col("a")).withColumn("d", F.col("_c") - F.col("c"))
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, "kmer")])
    p = statistics.bh_fdr(statistics.fisher_or(tables.withColumn("_row", row), "_row").select("_row", F.col("fisher_p").alias("p")), "p", "_row")
    a, c = F.col("a") + 0.5, F.col("c") + 0.5
    fold, odds = F.log2(a / (F.col("_a") + 0.5) / (c / (F.col("_c") + 0.5))), a * (F.col("d") + 0.5) / (c * (F.col("b") + 0.5))
    return tables.withColumn("_row", row).join(p, "_row").select(*by, "kmer", "a", "c", fold.alias("log2_fc"), odds.alias("odds_ratio"), "p", "q")


def logo_folds(df: DataFrame, group: str, min_train: int = 5) -> DataFrame:
    """Each group as a fold: its size, the rows left to train on, and too_small where these are few."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n_test"))
    got = sizes.join(F.broadcast(df.agg(F.count("*").alias("_n"))), F.lit(True)).withColumn("n_train", F.col("_n") - F.col("n_test")).drop("_n")
    return got.withColumn("status", F.when(F.col("n_train") < min_train, "too_small").otherwise("ok"))


def group_fold_greedy(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(group, n, fold): groups from the largest on, each to the fold with the fewest rows so far, the first of those on ties; equal groups in hash order.

    Groups of one size are a run: within it the folds are filled in the order of (rows + turns * size, fold), so the group of rank t finds the fold of
    the t-th such pair by itself. Only the table of sizes, of which N rows have under sqrt(2 N), is gone through one after another, on the driver. A null group is a group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    loads, starts = [0] * k, []
    for size, many in sorted(map(tuple, sizes.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True):
        starts.append((size, list(loads)))
        level = _fill_level(loads, size, many)
        turns = [max(0, (level - x + size - 1) // size) for x in loads]
        left = many - sum(turns)
        for f in range(k):  # those that stand at the level itself, the first folds first
            if left and level >= loads[f] and (level - loads[f]) % size == 0:
                turns[f], left = turns[f] + 1, left - 1
        loads = [x + t * size for x, t in zip(loads, turns, strict=True)]
    table = df.sparkSession.createDataFrame(starts, "n bigint, _loads array<bigint>")
    ranked = splits.hash_rank(sizes, group, seed, "_t", by=("n",)).join(table, "n")
    under = lambda v: F.aggregate(F.transform("_loads", lambda x: F.greatest(F.ceil((v - x) / F.col("n")), F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x)  # noqa: E731  pairs below v
    low, high = F.array_min("_loads"), F.array_max("_loads") + F.col("n") * (F.col("_t") + 1)
    half = lambda acc: F.floor((acc["a"] + acc["b"] + 1) / 2)
    step = lambda acc, _: F.when(acc["a"] >= acc["b"], acc).when(under(half(acc)) <= F.col("_t"), F.struct(half(acc).alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), (half(acc) - 1).alias("b")))
    found = ranked.withColumn("_v", F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(low.alias("a"), high.cast("bigint").alias("b")), step)["a"])
    at = F.filter(F.transform("_loads", lambda x, f: F.when((F.col("_v") >= x) & ((F.col("_v") - x) % F.col("n") == 0), f)), lambda f: f.isNotNull())
    return found.select(group, "n", F.get(at, (F.col("_t") - under(F.col("_v"))).cast("int")).cast("int").alias("fold"))


def _fill_level(loads: list[int], size: int, many: int) -> int:
    """The largest v with at most `many` pairs (load + turns * size) below it."""
    low, high = min(loads), max(loads) + size * (many + 1)
    while low < high:
        v = (low + high + 1) // 2
        low, high = (v, high) if sum(max(0, -(-(v - x) // size)) for x in loads) <= many else (low, v - 1)
    return low


def temporal_holdout(df: DataFrame, year: Column, group: str | None = None) -> DataFrame:
    """split: train up to the median year, test after it; with group, by the group's first year."""
    dated = df.withColumn("year", year)
    if group:
        dated = dated.drop("year").join(dated.groupBy(group).agg(F.min("year").alias("year")), group)
        middle = dated.select(group, "year").distinct()
    else:
        middle = dated
    cut = F.broadcast(middle.agg(F.percentile("year", F.lit(0.5)).alias("_m")))
    return dated.join(cut, F.lit(True)).withColumn("split", F.when(F.col("year") <= F.col("_m"), "train").otherwise("test")).drop("_m")


def value_holdout(df: DataFrame, col: str, value, disjoint: str | None = None) -> DataFrame:
    """split: test for the rows whose col is the value, train for the others.

    This is the cross-host rule, the one that leaves out a family or genus, and the geographic one; with disjoint (say, the species) rows of
    other values that share it with a test row are `dropped`. A null col trains.
    """
    test = F.col(col).eqNullSafe(F.lit(value))
    if disjoint is None:
        return df.withColumn("split", F.when(test, "test").otherwise("train"))
    seen = df.where(test & F.col(disjoint).isNotNull()).select(disjoint).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, disjoint, "left").withColumn("split", F.when(test, "test").when(F.col("_seen"), "dropped").otherwise("train")).drop("_seen")


def prepare_split(df: DataFrame, group: str, label: str, test_size: float = 0.2, seed: int = 42, legacy: bool = False, id_col: str | None = None) -> DataFrame:
    """Groups split apart, then the smaller class of the training rows repeated; validation rows stay single.

    legacy repeats first and then splits rows by class in hash order of id_col, so copies of a row may lie on both sides, as the
    older protocol had it.
    """
    if legacy:
        more = splits.oversample_minority(df, label).withColumn("_key", F.concat_ws("|", F.col(id_col).cast("string"), F.col("copy").cast("string")))
        ranked = null_safe_join(splits.hash_rank(more, "_key", seed, "_r", by=(label,)), more.groupBy(label).agg(F.count("*").alias("_n")), [label])
        return ranked.withColumn("split", F.when(F.col("_r") < F.ceil(F.col("_n") * test_size), "val").otherwise("train")).drop("_r", "_n", "_key")
    parted = splits.group_split(df, group, test_size, seed)
    train, val = parted.where("split = 'train'"), parted.where("split = 'val'")
    keys = [group] + ([id_col] if id_col else [])
    assert_disjoint(train, val, keys)
    train = splits.oversample_minority(train, label)
    assert_disjoint(train, val, keys)
    return train.unionByName(val.withColumn("copy", F.lit(1)))


def assert_disjoint(train: DataFrame, val: DataFrame, cols: list[str], shown: int = 5) -> None:
    """ValueError that names up to `shown` ids or groups if both splits have any."""
    both = shared_keys(train, val, cols).limit(shown).collect()
    if both:
        raise ValueError("train and validation share " + ", ".join(f"{r['kind']} {r['value']}" for r in both))


def shared_keys(train: DataFrame, val: DataFrame, cols: list[str]) -> DataFrame:
    """(kind, value) of ids or groups in both splits; empty if they are disjoint."""
    parts = [train.select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")).intersect(val.select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"))) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_manifest(dev: DataFrame, held: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows of dev whose id and whose content are not in the held-out rows."""
    seen = held.select(F.md5(text).alias("_d")).where("_d is not null").distinct()
    return dev.join(held.select(id_col).distinct(), id_col, "left_anti").withColumn("_d", F.md5(text)).join(seen, "_d", "left_anti").drop("_d")


def sample_manifest(df: DataFrame, id_col: str, group: str, n: int, min_per_group: int = 2, seed: int = 42) -> DataFrame:
    """n rows by hash of each group that has min_per_group or more."""
    order = Window.partitionBy(group).orderBy(draw(seed, F.col(id_col)), id_col)
    got = df.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    return got.where((F.col("_n") >= min_per_group) & (F.col("_r") <= n)).drop("_r", "_n")


def geometry_report(df: DataFrame, id_col: str, label: str, group: str, block: str) -> DataFrame:
    """One row: group sizes, share of label variance between groups, mean purity of blocks, blocks shared by random folds.

    block_homogeneity is the mean purity for a label of two values at most, else the share of variance between blocks.
    """
    homogeneity = statistics.purity(df, label, block).agg(F.avg("purity").alias("mean_purity"))
    between = statistics.icc_groups(df, label, block).select(F.col("eta_squared").alias("_between"))
    kinds = df.agg(F.count_distinct(label).alias("_kinds"))
    parts = [statistics.group_sizes(df, group), statistics.icc_groups(df, label, group), homogeneity, splits.shared_block_fraction(df, id_col, block), between, kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out.withColumn("block_homogeneity", F.when(F.col("_kinds") <= 2, F.col("mean_purity")).otherwise(F.col("_between"))).drop("_between", "_kinds")
