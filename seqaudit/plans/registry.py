"""All queries of the core library and their SQL. Doubles are rounded, as sums depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tails import binomial_at_least
from ..operators import intervals as I
from ..operators import rows as R
from ..operators import splits as K
from ..operators import statistics as S
from ..operators import tables as T
from .fixtures import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query given a function of a table getter."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = build(lambda table: view(spark, sf_dir, table))
            return got.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in got.dtypes])

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = ctes(" ".join(sql.split("\n")).strip())
        return build

    return add


HASH = "('0x' || substr(md5({}), 1, 8))::bigint"
CLEAN = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"

query("finite_rows", "select vec_id, round(y, 6) as y from v_emb where isfinite(y) and len([x for x in features if not isfinite(x)]) = 0")(lambda t: R.finite_rows(t("v_emb"), "y", "features").select("vec_id", "y"))
query("coerce_label", "select doc_id, round(try_cast(source as double), 6) as source, round(try_cast(cast(n_chars as varchar) as double), 6) as n from documents")(
    lambda t: R.coerce_label(R.coerce_label(t("documents").select("doc_id", "source", F.col("n_chars").cast("string").alias("n")), "source"), "n")
)
query("label_kind", "select count(distinct label) as n_values, count(distinct label) = 2 as is_binary from v_manifest where isfinite(label)")(lambda t: R.label_kind(t("v_manifest"), "label"))
query("fill_default", "select e.event_id, coalesce(nullif(e.event_type, 'view'), 'NA') as kind from events e")(
    lambda t: R.fill_default(t("events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind")), "kind", F.lit("NA"))
)
query("dedupe_key", "select text, min(doc_id) as doc_id from documents group by text")(lambda t: R.dedupe_key(t("documents"), ["text"], [F.col("doc_id")]).select("text", "doc_id"))
query("row_id", "select doc_id, case when doc_id % 3 = 0 then cast(doc_id as varchar) else substr(sha256(text), 1, 40) end as row_id from documents")(
    lambda t: R.row_id(t("documents").withColumn("acc", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))), "acc", "text").select("doc_id", "row_id")
)
query("membership_flag", "select doc_id, case when doc_id in (select doc_id from labels) then 1 else 0 end as in_panel from documents")(lambda t: R.membership_flag(t("documents").select("doc_id"), "doc_id", t("labels")))
query("clip_log_ratio", "select l_orderkey, l_linenumber, round(greatest(least(ln(r) / 0.25, 3.0), -3.0), 6) as z from (select *, l_extendedprice / 30000.0 as r from lineitem) x")(
    lambda t: R.clip_log_ratio(t("lineitem").withColumn("r", F.col("l_extendedprice") / 30000.0), "r").select("l_orderkey", "l_linenumber", "z")
)
query("safe_ratio", "select event_id, round(value / nullif(event_id % 5, 0), 6) as ratio from events")(lambda t: R.safe_ratio(t("events").withColumn("d", F.col("event_id") % 5), "value", "d").select("event_id", "ratio"))
query("gc_full", "select doc_id, round((length(text) - length(translate(text, 'GCgc', ''))) / nullif(length(text), 0), 6) as gc from documents")(lambda t: R.gc_full(t("documents"), "text").select("doc_id", "gc"))
query("gc_acgt", f"select doc_id, round((length(s) - length(translate(s, 'GC', ''))) / nullif(length(s), 0), 6) as gc from (select doc_id, {CLEAN} as s from documents) x")(lambda t: R.gc_acgt(t("documents"), "text").select("doc_id", "gc"))
query("dinuc_frac", f"select doc_id, round(len([i for i in range(1, length(s)) if substr(s, i, 2) = 'CA']) / nullif(length(s) - 1, 0), 6) as frac from (select doc_id, {CLEAN} as s from documents) x where length(s) > 1")(
    lambda t: R.dinuc_frac(t("documents"), "text", "CA").where("frac is not null").select("doc_id", "frac")
)
def kmers(k):
    return f"with k as (select doc_id, substr(s, i, {k}) as kmer from (select doc_id, s, unnest(range(1, length(s) - {k - 2})) as i from (select doc_id, {CLEAN} as s from documents) x) y) select doc_id, kmer, count(*) as n, round(count(*) / sum(count(*)) over (partition by doc_id), 6) as freq from k group by doc_id, kmer"


query("kmer_freq", kmers(3))(
    lambda t: R.kmer_counts(t("documents"), "doc_id", "text")
)
NAMES = "case p_size % 4 when 0 then 'Pandemic virus' when 1 then 'Animal to human transmission' when 2 then 'Geography of the host(s)' else 'Genome type' end"
TEXT = (f"concat('Risk Name: ', {NAMES}, chr(10), 'Weighted Score: ', p_size, chr(10), 'Risk Name: Host plasticity - No. of orders', chr(10), 'Weighted Score: ', p_partkey % 50, chr(10), 'Impact Score: 2')")
FACTORS = f"select p_partkey, {NAMES} as name, cast(p_size as double) as weighted from part union all select p_partkey, 'Host plasticity - No. of orders', cast(p_partkey % 50 as double) from part"


def factors(t):
    return parsed(t).select("p_partkey", "name", "weighted")


def parsed(t):
    return R.parse_factors(t("part").withColumn("risk", F.expr(TEXT)), "p_partkey", "risk")


query("parse_factors", f"select *, cast(null as double) as risk_score, case when name like 'Host plasticity%' then 2.0 end as impact from ({FACTORS}) x")(parsed)
query("flag_factors", f"select p_partkey, name, weighted, case when name ilike '%pandemic%' or name ilike '%human transmission%' then 1 else 0 end as circular, case when name ilike '%host%' then 1 else 0 end as host_axis from ({FACTORS}) x")(
    lambda t: R.flag_factors(factors(t), {"circular": "pandemic|human transmission", "host_axis": "host"})
)
query("factor_catalog", f"select name, count(*) as n from ({FACTORS}) x group by name")(lambda t: T.factor_catalog(factors(t)))
query("factor_scores", f"select p_partkey, count(*) as n_factors, sum(weighted) as total, sum(case when name ilike '%pandemic%' then weighted else 0.0 end) as circular, sum(case when name ilike '%pandemic%' then 0.0 else weighted end) as ablated from ({FACTORS}) x group by p_partkey")(
    lambda t: T.factor_scores(R.flag_factors(factors(t), {"c": "pandemic"}), "p_partkey", "c")
)
query("join_scores", "select d.doc_id, l.quality, case when l.doc_id is null then 0 else 1 end as matched from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id)")(
    lambda t: T.join_scores(t("documents").select("doc_id"), t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "doc_id").select("doc_id", "quality", "matched")
)
query("lookup_attrs", "select o.o_orderkey, c.c_name, c.c_nationkey from orders o join customer c on o.o_custkey = c.c_custkey")(lambda t: T.lookup_attrs(t("orders").select("o_orderkey", "o_custkey"), t("customer"), "o_custkey", "c_custkey", ["c_name", "c_nationkey"]).drop("o_custkey"))
query("merge_intervals", "select accession, cls, s0, s1 from v_merged")(lambda t: I.merge_intervals(t("v_span"), ["accession", "cls"]))
query("interval_overlap", "select w.accession, w.window_index, w.w0, w.w1, m.cls, cast(sum(least(w.w1, m.s1) - greatest(w.w0, m.s0)) as bigint) as covered, round(sum(least(w.w1, m.s1) - greatest(w.w0, m.s0)) / (w.w1 - w.w0), 6) as frac from v_window w join v_merged m on w.accession = m.accession and m.s0 < w.w1 and m.s1 > w.w0 group by w.accession, w.window_index, w.w0, w.w1, m.cls")(
    lambda t: I.interval_overlap(t("v_window"), t("v_span"))
)
query("point_in_interval", "select t.accession, t.pos, m.cls from v_track t join v_merged m on t.accession = m.accession and t.pos >= m.s0 and t.pos < m.s1")(lambda t: I.point_in_interval(t("v_track").select("accession", "pos"), t("v_span")))
UNION = "(select accession, pos from v_track t where exists (select 1 from v_merged m where m.accession = t.accession and t.pos >= m.s0 and t.pos < m.s1))"
query("region_lengths", f"select g.accession, g.n, x.cls, cast(x.len as bigint) as len, round(x.len / g.n, 6) as frac from v_genome g join (select accession, cls, sum(s1 - s0) as len from v_merged group by 1, 2 union all select accession, 'any', count(*) from {UNION} u group by 1 union all select g.accession, 'other', g.n - coalesce(k, 0) from v_genome g left join (select accession, count(*) as k from {UNION} u group by 1) u using (accession)) x using (accession)")(
    lambda t: I.region_lengths(t("v_genome"), t("v_span"))
)
query("complement_class", f"select accession, cast(sum(1) as bigint) as n_positions from v_track t where (accession, pos) not in (select accession, pos from {UNION} u) group by accession")(
    lambda t: I.complement(t("v_genome"), t("v_span")).groupBy("accession").agg(F.sum(F.col("s1") - F.col("s0")).cast("bigint").alias("n_positions"))
)
query("mass_enrichment", "select m.accession, m.cls, round(sum(abs(t.attr)) / g.total / (count(*) / g.n), 6) as enrichment from v_track t join v_merged m on t.accession = m.accession and t.pos >= m.s0 and t.pos < m.s1 join (select accession, sum(abs(attr)) as total, count(*) as n from v_track group by 1) g on g.accession = t.accession group by m.accession, m.cls, g.total, g.n")(
    lambda t: I.mass_enrichment(t("v_track"), t("v_span"))
)
query("equal_windows", "select accession, i as window_index, cast(floor(i * n / 5.0) as int) as w0, cast(floor((i + 1) * n / 5.0) as int) as w1 from v_genome cross join (select unnest(range(0, 5))::int as i) k")(lambda t: I.equal_windows(t("v_genome"), 5))


def scored(t):
    return I.window_scores(t("v_track"), t("v_window"))


query("window_scores", "select accession, window_index, w0, w1, round(score, 6) as score from v_scored")(scored)
ORDER = "partition by accession order by round(score, 6) desc, window_index"
query("rank_windows", f"select accession, window_index, row_number() over ({ORDER}) as rank, row_number() over ({ORDER}) = 1 as is_top, row_number() over ({ORDER}) <= greatest(1, count(*) over (partition by accession) // 2) as is_high from v_scored")(
    lambda t: I.rank_windows(scored(t).withColumn("score", F.round("score", 6))).select("accession", "window_index", "rank", "is_top", "is_high")
)
query("top_window", f"select accession, window_index from (select *, row_number() over ({ORDER}) as r from v_scored) x where r = 1")(lambda t: I.rank_windows(scored(t).withColumn("score", F.round("score", 6))).where("is_top").select("accession", "window_index"))
query("top_quantile", "select accession, pos, row_number() over (partition by accession order by abs(attr) desc, pos) <= greatest(1, ceil(count(*) over (partition by accession) * 0.1)) as is_top from v_track")(lambda t: I.top_quantile(t("v_track"), 0.1).select("accession", "pos", "is_top"))
query("top_positions", "select accession, pos, rank from (select *, row_number() over (partition by accession order by attr desc, pos) as rank from v_track) x where rank <= 3")(lambda t: I.top_positions(t("v_track")).select("accession", "pos", "rank"))
query("peak_fragment", "select accession, window_index, frag_start, round(frag, 6) as frag from (select *, row_number() over (partition by accession, window_index order by round(frag, 6) desc, frag_start) as r from (select w.accession, w.window_index, w.w1, t.pos as frag_start, sum(abs(t.attr)) over (partition by w.accession, w.window_index order by t.pos rows between current row and 4 following) as frag from v_window w join v_track t on t.accession = w.accession and t.pos >= w.w0 and t.pos < w.w1) x where frag_start + 5 <= w1) y where r = 1")(
    lambda t: I.peak_fragment(t("v_track"), t("v_window"), 5)
)
query(
    "sliding_starts_overlap",
    """select distinct accession, start from (
  select accession, unnest(range(0, greatest(n - 20, 0) + 1, 10))::int as start from v_genome union all select accession, greatest(n - 20, 0)::int from v_genome) x""",
)(lambda t: I.sliding_starts(t("v_genome"), "n", 20, overlap=0.7).select("accession", "start"))
query("sliding_starts", "select distinct accession, start from (select accession, unnest(range(0, greatest(n - 20, 0) + 1, 7))::int as start from v_genome union all select accession, greatest(n - 20, 0)::int from v_genome) x")(lambda t: I.sliding_starts(t("v_genome"), "n", 20, 7).select("accession", "start"))
SHIFT_COUNT = 2000  # as published
SHIFTS = f"""with drawn as (
  select g.accession, g.n, {HASH.format("'42|' || p.perm || '|' || g.accession")} % g.n as mv from v_genome g cross join (select unnest(range(1, {SHIFT_COUNT + 1})) as perm) p),
mv as (select accession, n, mv, sum(k) as times from (select *, 1 as k from drawn union all select accession, n, 0, 0 from v_genome) x group by 1, 2, 3),
mass as (
  select v.accession, m.cls, v.mv, any_value(v.times) as times, round(sum(abs(t.attr)), 6) as mass
  from mv v join v_merged m on m.accession = v.accession
  join v_track t on t.accession = v.accession and (t.pos - v.mv + v.n) % v.n >= m.s0 and (t.pos - v.mv + v.n) % v.n < m.s1 group by 1, 2, 3),
mean as (select accession, cls, sum(times * mass) / {SHIFT_COUNT} as mean from mass group by 1, 2)
select n.accession, n.cls, o.mass as observed, round((1 + sum(case when n.mass >= o.mass then n.times else 0 end)) / (1 + {SHIFT_COUNT}), 6) as p,
  round(any_value(mean.mean), 6) as null_mean, round(sqrt(sum(n.times * (n.mass - mean.mean) ** 2) / {SHIFT_COUNT}), 6) as null_sd
from mass n join mass o on n.accession = o.accession and n.cls = o.cls and o.mv = 0 join mean on mean.accession = n.accession and mean.cls = n.cls group by 1, 2, 3"""
query("shift_null", SHIFTS)(lambda t: I.shift_null(t("v_track"), t("v_span"), SHIFT_COUNT))


def contrast(t):
    ranked = I.rank_windows(scored(t).withColumn("score", F.round("score", 6)))
    classes = t("v_span").select("cls").distinct()
    grid = ranked.select("accession", "window_index", "is_high").join(F.broadcast(classes), F.lit(True))
    cover = I.interval_overlap(t("v_window"), t("v_span")).select("accession", "window_index", "cls", "frac")
    rows = grid.join(cover, ["accession", "window_index", "cls"], "left").withColumn("inside", F.coalesce(F.col("frac") >= 0.5, F.lit(False)))
    return S.contingency(rows, "cls", "is_high", "inside")


CONTRAST = f"""with r as (select accession, window_index, row_number() over ({ORDER}) <= greatest(1, count(*) over (partition by accession) // 2) as is_high from v_scored),
o as (select w.accession, w.window_index, m.cls, sum(least(w.w1, m.s1) - greatest(w.w0, m.s0)) / (w.w1 - w.w0) as frac from v_window w join v_merged m on w.accession = m.accession and m.s0 < w.w1 and m.s1 > w.w0 group by w.accession, w.window_index, m.cls, w.w0, w.w1),
g as (select r.*, c.cls, coalesce(o.frac >= 0.5, false) as inside from r cross join (select distinct cls from v_span) c left join o on o.accession = r.accession and o.window_index = r.window_index and o.cls = c.cls),
tab as (select cls, cast(count_if(is_high and inside) as bigint) as a, cast(count_if(is_high and not inside) as bigint) as b, cast(count_if(not is_high and inside) as bigint) as c, cast(count_if(not is_high and not inside) as bigint) as d from g group by cls) """
query("contingency", CONTRAST + "select * from tab")(contrast)
HALDANE = "round(a * d / nullif(b * c, 0), 6) as odds_ratio, round(exp(ln((a+.5)*(d+.5)/((b+.5)*(c+.5)))), 6) as haldane_or, round(exp(ln((a+.5)*(d+.5)/((b+.5)*(c+.5))) - 1.96 * sqrt(1/(a+.5)+1/(b+.5)+1/(c+.5)+1/(d+.5))), 6) as ci_low, round(exp(ln((a+.5)*(d+.5)/((b+.5)*(c+.5))) + 1.96 * sqrt(1/(a+.5)+1/(b+.5)+1/(c+.5)+1/(d+.5))), 6) as ci_high"
query("haldane_or", CONTRAST + f"select cls, a, b, c, d, {HALDANE} from tab")(lambda t: S.haldane_or(contrast(t)))
LOGC = "lgamma(r+1) + lgamma(n-r+1) + lgamma(k+1) + lgamma(n-k+1) - lgamma(n+1) - lgamma({0}+1) - lgamma(r-{0}+1) - lgamma(k-{0}+1) - lgamma(n-r-k+{0}+1)"
FISHER = f"tt as (select *, a+b as r, a+c as k, a+b+c+d as n from tab), gr as (select *, unnest(range(greatest(0, r+k-n), least(r, k) + 1)) as x from tt), fp as (select cls, a, b, c, d, least(1.0, sum(case when exp({LOGC.format('x')}) <= exp({LOGC.format('a')}) * (1 + 1e-7) then exp({LOGC.format('x')}) else 0 end)) as fisher_p from gr group by 1, 2, 3, 4, 5) "
query("fisher_or", CONTRAST.rstrip() + ", " + FISHER + "select cls, a, b, c, d, round(fisher_p, 6) as fisher_p from fp")(lambda t: S.fisher_or(contrast(t), "cls"))
BH = "select cls, round(least(1.0, min(pr * m / rk) over (order by rk desc rows unbounded preceding)), 6) as q from (select cls, round(fisher_p, 9) as pr, count(*) over () as m, row_number() over (order by round(fisher_p, 9), cls) as rk from fp) z"
query("bh_fdr", CONTRAST.rstrip() + ", " + FISHER + BH)(lambda t: S.bh_fdr(S.fisher_or(contrast(t), "cls").select("cls", F.round("fisher_p", 9).alias("p")), "p", "cls").select("cls", "q"))
SIGN = "lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + x * ln(p0) + (a + b - x) * ln(1 - p0)"
query("high_low_contrast", CONTRAST.rstrip() + ", " + FISHER + f", bh as ({BH}), s as (select cls, least(1.0, sum(exp({SIGN}))) as sign_p from (select *, greatest(1e-6, least(1 - 1e-6, (a + c) / (a + b + c + d))) as p0, unnest(range(a, a + b + 1)) as x from fp) y group by 1) select cls, a, b, c, d, {HALDANE}, round(fisher_p, 6) as fisher_p, q, round(sign_p, 6) as sign_p from fp join bh using (cls) join s using (cls)")(
    lambda t: contrast_report(contrast(t))
)


def contrast_report(tables):
    """Odds ratios, Fisher p and q, and the sign test of the high windows against the class's share of all."""
    a, b, c, d = (F.col(x) for x in "abcd")
    p0 = F.least(F.greatest((a + c) / (a + b + c + d), F.lit(1e-6)), F.lit(1 - 1e-6))
    own = binomial_at_least(S.haldane_or(S.fisher_or(tables, "cls")), a + b, a, p0, "sign_p")
    q = S.bh_fdr(own.select("cls", F.round("fisher_p", 9).alias("p")), "p", "cls").select("cls", "q")
    return own.join(q, "cls").select("cls", "a", "b", "c", "d", "odds_ratio", "haldane_or", "ci_low", "ci_high", "fisher_p", "q", "sign_p")


RANKS = "avg(x) over w"
query("average_rank", "select doc_id, b + (c + 1) / 2 as rank from (select doc_id, rank() over (order by n_chars) - 1 as b, count(*) over (partition by n_chars) as c from documents) x")(lambda t: S.average_rank(t("documents").select("doc_id", "n_chars"), "n_chars", [], "rank").select("doc_id", "rank"))
query("spearman", "select lang, count(*) as n, case when count(*) >= 10 then round(corr(ra, rb), 6) end as rho from (select lang, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2 as ra, rank() over (partition by lang order by source) + (count(*) over (partition by lang, source) - 1) / 2 as rb from documents) x group by lang")(
    lambda t: S.spearman(t("documents").select("lang", "n_chars", "source"), "n_chars", "source", ["lang"])
)
SCORE = "(doc_id * 37 % 101) / 101.0"
PRED = f"(select d.lang, l.toxic as y, {SCORE} as s from documents d join labels l using (doc_id))"


def pred(t):
    return t("documents").join(t("labels"), "doc_id").select("lang", F.col("toxic").alias("y"), (F.col("doc_id") * 37 % 101 / 101.0).alias("s"))


query("auroc", f"select lang, round(sum(case when y = 1 then u else 0 end) / nullif(count_if(y = 1) * count_if(y = 0), 0), 6) as auroc from (select p.lang, p.y, p.s, (select count(*) + 0.0 from {PRED} q where q.lang = p.lang and q.y = 0 and q.s < p.s) + (select count(*) / 2 from {PRED} q where q.lang = p.lang and q.y = 0 and q.s = p.s) as u from {PRED} p) x group by lang")(
    lambda t: S.auroc(pred(t), "y", "s", ["lang"])
)
query("avg_precision", f"with v as (select lang, s, count_if(y = 1) as p, count(*) as n from {PRED} x group by 1, 2) select lang, round(sum(p * tp / al) / nullif(sum(p), 0), 6) as avg_precision from (select *, sum(p) over (partition by lang order by s desc) as tp, sum(n) over (partition by lang order by s desc) as al from v) z group by lang")(
    lambda t: S.average_precision(pred(t), "y", "s", ["lang"])
)
WEIGHTED = f"(select y, s, 1.0 / count(*) over (partition by lang) as w from {PRED} x)"
query(
    "auroc_weighted",
    f"""select round(sum(case when p.y = 1 and n.y = 0 then p.w * n.w * case when n.s < p.s then 1.0 when n.s = p.s then 0.5 else 0.0 end else 0.0 end)
  / nullif(sum(case when p.y = 1 and n.y = 0 then p.w * n.w else 0.0 end), 0), 6) as auroc from {WEIGHTED} p cross join {WEIGHTED} n""",
)(lambda t: S.auroc(pred(t).withColumn("w", 1 / F.count("*").over(Window.partitionBy("lang"))), "y", "s", [], "w"))
query("class_metrics", f"select lang, count(*) as n, round(avg(case when (s >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy, round(coalesce(count_if(s >= 0.5 and y = 1) / nullif(count_if(s >= 0.5), 0), 0.0), 6) as precision, round(coalesce(count_if(s >= 0.5 and y = 1) / nullif(count_if(y = 1), 0), 0.0), 6) as recall, round(coalesce(2 * count_if(s >= 0.5 and y = 1) / nullif(count_if(s >= 0.5) + count_if(y = 1), 0), 0.0), 6) as f1 from {PRED} x group by lang")(
    lambda t: S.class_metrics(pred(t), "y", "s", ["lang"])
)
query("reg_metrics", "select l_returnflag, round(avg((l_quantity - l_linenumber) ** 2), 6) as mse, round(avg(abs(l_quantity - l_linenumber)), 6) as mae, round(1 - avg((l_quantity - l_linenumber) ** 2) / var_pop(l_quantity), 6) as r2, round(corr(l_quantity, l_linenumber), 6) as pearson from lineitem group by 1")(
    lambda t: S.reg_metrics(t("lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("p")), "y", "p", ["l_returnflag"])
)
query("group_sizes", "select count(*) as n_groups, min(n) as min_size, max(n) as max_size, quantile_cont(n, 0.5) as median_size, round(avg(case when n = 1 then 1.0 else 0.0 end), 6) as singleton_share from (select group_id, count(*) as n from v_manifest group by 1) x")(lambda t: S.group_sizes(t("v_manifest"), "group_id"))
query("percentile_ci", "select event_type, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as sd, round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.975), 6) as hi, count(value) as n from events group by 1")(lambda t: S.percentile_ci(t("events"), "event_type", "value"))
query("median_by_name", "select event_type, round(quantile_cont(value, 0.5), 6) as median from events group by 1")(lambda t: T.median_by_name(t("events"), "event_type", ["value"]).withColumnRenamed("value", "median"))
query("any_yes", "select p_brand, max(case when p_partkey % 5 = 0 then 1 else 0 end) as any_yes from part group by 1")(lambda t: T.any_yes(t("part").withColumn("any_yes", F.when(F.col("p_partkey") % 5 == 0, "Yes").otherwise("No")), "p_brand", ["any_yes"]))
query("icc_groups", "with k as (select * from v_manifest where label is not null and group_id is not null), m as (select group_id, count(*) as n, avg(label) as m from k group by 1), a as (select avg(label) as al, var_pop(label) * count(*) as ss from k) select case when count(*) > 1 then round(case when max(ss) <= 1e-12 then 1.0 else greatest(0, least(1, sum(n * (m - al) ** 2) / max(ss))) end, 6) end as eta_squared from m cross join a")(lambda t: S.icc_groups(t("v_manifest"), "label", "group_id"))
query("purity", "select block_id, round(max(n) / sum(n), 6) as purity, cast(sum(n) as bigint) as n from (select block_id, label, count(*) as n from v_manifest where label is not null group by 1, 2) x group by 1")(lambda t: S.purity(t("v_manifest"), "label", "block_id"))
query("mean_pool", "with e as (select group_id, unnest(features) as x, unnest(range(0, len(features))) as i from v_emb) select group_id, i, round(avg(x), 6) as x from e group by 1, 2")(
    lambda t: S.mean_pool(t("v_emb"), "group_id").select("group_id", F.posexplode("pooled").alias("i", "x")).select("group_id", F.col("i").cast("bigint").alias("i"), "x")
)
query("group_macro", "select group_id, round(avg(label), 6) as mean_y, round(avg(n_chars), 6) as mean_pred from v_manifest group by 1")(lambda t: S.group_macro(t("v_manifest"), "group_id", "label", "n_chars"))
A, B = "(select * from v_manifest where sequence_id % 3 <> 0)", "(select * from v_manifest where sequence_id % 3 = 0 or sequence_id % 7 = 0)"


def split_a(t):
    return t("v_manifest").where("sequence_id % 3 <> 0")


def split_b(t):
    return t("v_manifest").where("sequence_id % 3 = 0 or sequence_id % 7 = 0")


query("overlap_audit", f"with i as (select distinct sequence_id from {A} a where sequence_id in (select sequence_id from {B} b)), k as (select distinct group_id from {A} a where group_id in (select group_id from {B} b)) select (select count(*) from {A} a) as n_a, (select count(distinct sequence_id) from {A} a) as ids_a, (select count(*) from {B} b) as n_b, (select count(distinct sequence_id) from {B} b) as ids_b, (select count(*) from i) as shared_ids, (select count(*) from k) as shared_blocks, round((select count(*) from i) / (select count(distinct sequence_id) from {B} b), 6) as share_ids, (select string_agg(sequence_id, ',' order by sequence_id) from (select sequence_id from i order by 1 limit 50) z) as first_shared")(
    lambda t: S.overlap_audit(split_a(t), split_b(t), "sequence_id", "group_id").select("n_a", "ids_a", "n_b", "ids_b", "shared_ids", "shared_blocks", "share_ids", F.array_join(F.col("first_shared").cast("array<string>"), ",").alias("first_shared"))
)
query("content_overlap", f"select a.digest, a.id as id_a, b.id as id_b, a.n as n_a, b.n as n_b from (select md5(text) as digest, min(sequence_id) as id, count(*) as n from {A} x where text is not null group by 1) a join (select md5(text) as digest, min(sequence_id) as id, count(*) as n from {B} x where text is not null group by 1) b using (digest)")(lambda t: S.content_overlap(split_a(t), split_b(t), "sequence_id", "text"))
query("intersect_ids", f"select distinct sequence_id from {A} a where sequence_id in (select sequence_id from {B} b)")(lambda t: T.intersect_ids(split_a(t), split_b(t), "sequence_id"))
query("union_models", f"select 'a' as split, group_id, count(*) as n from {A} x group by 2 union all select 'b', group_id, count(*) from {B} x group by 2")(
    lambda t: T.union_models({"a": split_a(t), "b": split_b(t)}, "split").groupBy("split", "group_id").agg(F.count("*").alias("n"))
)
DEAL = "with g as (select group_id, row_number() over (order by {h}, group_id) as r, count(*) over () as n from (select distinct group_id from v_manifest) z) "
GROUP_HASH = HASH.format("'42|' || group_id")
query("group_split", DEAL.format(h=GROUP_HASH) + "select m.sequence_id, m.group_id, case when g.r <= ceil(g.n * 0.2) then 'val' else 'train' end as split from v_manifest m join g using (group_id)")(lambda t: K.group_split(t("v_manifest"), "group_id").select("sequence_id", "group_id", "split"))
query("group_fold_random", DEAL.format(h=GROUP_HASH) + "select m.sequence_id, cast((g.r - 1) % 5 as int) as fold from v_manifest m join g using (group_id)")(lambda t: K.group_fold_random(t("v_manifest"), "group_id").select("sequence_id", F.col("fold").cast("int").alias("fold")))
FOLD = f"(select *, (row_number() over (order by {HASH.format("'42|' || sequence_id")}, sequence_id) - 1) % 5 as fold from v_manifest)"
query("kfold_random", f"select sequence_id, cast(fold as int) as fold from {FOLD} x")(lambda t: K.kfold_random(t("v_manifest"), "sequence_id").select("sequence_id", F.col("fold").cast("int").alias("fold")))
query("shared_block_fraction", f"with f as (select block_id, fold, count(*) as n, sum(count(*)) over (partition by block_id) as al from {FOLD} x group by 1, 2) select round(avg(x), 6) as shared_block_fraction from (select fold, sum(case when al > n then n else 0 end) / sum(n) as x from f group by fold) y")(lambda t: K.shared_block_fraction(t("v_manifest"), "sequence_id", "block_id"))
query("oversample_minority", "with c as (select label, count(*) as n from v_manifest group by 1) select sequence_id, label, cast(unnest(range(1, case when label = (select label from c order by n, label limit 1) then (select max(n) from c) // (select min(n) from c) else 1 end + 1)) as int) as copy from v_manifest")(
    lambda t: K.oversample_minority(t("v_manifest"), "label").select("sequence_id", "label", "copy")
)


def walked(keep: str, key: str) -> str:
    """Recursive table w: the place x of 0..n-1 to which each row (keep, i, n) of `ranks` goes under each perm of `perms`, by the rounds of shuffled_place."""
    def once(source):
        step = f"select {keep}, perm, i, n, a, x // a as l0, x % a as r0 from {source}"
        for j in range(4):
            turn = HASH.format(f"'42|' || perm {key} || '|{j}|' || r{j}")
            step = f"select {keep}, perm, i, n, a, r{j} as l{j + 1}, (l{j} + {turn}) % a as r{j + 1} from ({step}) s{j}"
        return f"select {keep}, perm, i, n, a, a * l4 + r4 as x from ({step}) e"

    first = f"(select {keep}, perm, i, n, cast(greatest(ceil(sqrt(n)), 1) as bigint) as a, i as x from ranks cross join perms) first"
    return f"w as ({once(first)} union all {once('(select * from w where x >= n) more')})"


ROW_HASH = HASH.format("'42|' || sequence_id")
query(
    "label_perm_within",
    f"""with recursive perms as (select cast(unnest(range(1, 401)) as int) as perm),
ranks as (
  select sequence_id as id, block_id, label, row_number() over (partition by block_id order by {ROW_HASH}, sequence_id) - 1 as i, count(*) over (partition by block_id) as n from v_manifest),
{walked("id, block_id", "|| '|' || block_id")}
select w.perm, w.id, r.label as permuted from w join ranks r on r.block_id = w.block_id and r.i = w.x where w.x < w.n""",
)(lambda t: K.label_perm(t("v_manifest"), "sequence_id", "label", "block_id", 400))
GROUP_RANK = f"(select group_id, row_number() over (order by {GROUP_HASH}, group_id) - 1 as k, count(*) over () as n from (select distinct group_id from v_manifest) z)"
query(
    "group_bootstrap",
    f"""with g as {GROUP_RANK},
d as (select r.rep, {HASH.format("'42|' || r.rep || '|' || j.j")} % (select max(n) from g) as k from (select unnest(range(0, 2000)) as rep) r cross join (select k as j from g) j),
x as (select d.rep, m.label, m.n_chars from d join g using (k) join v_manifest m using (group_id)),
y as (select rep, rank() over (partition by rep order by label) + (count(*) over (partition by rep, label) - 1) / 2 as ra,
  rank() over (partition by rep order by n_chars) + (count(*) over (partition by rep, n_chars) - 1) / 2 as rb from x)
select cast(rep as int) as rep, count(*) as n, case when count(*) >= 10 and var_pop(ra) * var_pop(rb) > 0 then round(covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)), 6) end as rho from y group by rep""",
)(lambda t: K.group_bootstrap(t("v_manifest"), "group_id", "label", "n_chars", 2000))
