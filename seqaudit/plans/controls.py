"""Queries of the further controls, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as C
from ..operators import reports
from .registry import HASH, ORACLES, ROW_HASH, SHIFT_COUNT, query, walked

TOP = f"select accession, pos from ({ORACLES['top_quantile']}) z where is_top"
query("shift_top_null", f"""with top as ({TOP}),
mv as (select g.accession, g.n, p.perm, case when p.perm = 0 then 0 else {HASH.format("'42|' || p.perm || '|' || g.accession")} % g.n end as mv from v_genome g cross join (select unnest(range(0, 2001)) as perm) p),
h as (select v.accession, m.cls, v.perm, count(*) as h from mv v join top t on t.accession = v.accession join v_merged m on m.accession = v.accession and (t.pos + v.mv) % v.n >= m.s0 and (t.pos + v.mv) % v.n < m.s1 group by 1, 2, 3),
x as (select g.accession, g.cls, v.perm, coalesce(h.h, 0) / k.k as x from (select distinct accession, cls from v_merged) g join mv v on v.accession = g.accession join (select accession, count(*) as k from top group by 1) k on k.accession = g.accession left join h on h.accession = g.accession and h.cls = g.cls and h.perm = v.perm)
select n.accession, n.cls, round(o.x, 6) as observed, round((1 + count_if(n.x >= o.x)) / (1 + count(*)), 6) as p, round(avg(n.x), 6) as null_mean from x n join x o on o.accession = n.accession and o.cls = n.cls and o.perm = 0 where n.perm > 0 group by n.accession, n.cls, o.x""")(
    lambda t: C.shift_top_null(t("v_track"), t("v_span"), 0.1, 2000)
)
query(
    "label_perm_global",
    f"""with recursive perms as (select cast(unnest(range(1, 5001)) as int) as perm),
ranks as (
  select sequence_id as id, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as a0, rank() over (order by label) + (count(*) over (partition by label) - 1) / 2 as b0,
    row_number() over (order by {ROW_HASH}, sequence_id) - 1 as i, count(*) over () as n from v_manifest),
{walked("a0", "")},
s as (select w.perm, sum(w.a0 * r.b0) as x from w join ranks r on r.i = w.x where w.x < w.n group by 1),
f as (select count(*) as n, avg(a0) as ma, avg(b0) as mb, sqrt(var_pop(a0) * var_pop(b0)) as s, sum(a0 * b0) as seen from ranks),
rho as (select round((s.x / f.n - f.ma * f.mb) / f.s, 6) as rho, round((f.seen / f.n - f.ma * f.mb) / f.s, 6) as observed from s cross join f)
select observed, round(avg(rho), 6) as null_mean, round(stddev_pop(rho), 6) as null_sd, round((1 + count_if(rho >= observed)) / (1 + count(*)), 6) as p from rho group by observed""",
)(lambda t: C.label_perm_global(t("v_manifest"), "sequence_id", "n_chars", "label", 5000))
query("locus_percentile", """with l as (select m.accession, m.cls, m.s0, m.s1, g.n, m.s1 - m.s0 as l from v_merged m join v_genome g on g.accession = m.accession where m.s1 > m.s0),
w as (select *, unnest(range(-1, n // l)) as i from l),
e as (select *, case when i < 0 then s0 else i * l end as a from w),
m as (select e.accession, e.cls, e.s0, e.s1, e.i, round(avg(abs(t.attr)), 6) as m from e join v_track t on t.accession = e.accession and t.pos >= e.a and t.pos < e.a + e.l group by 1, 2, 3, 4, 5)
select n.accession, n.cls, n.s0, n.s1, o.m as score, round(count_if(n.m <= o.m) / count(*), 6) as percentile from m n join m o on o.accession = n.accession and o.cls = n.cls and o.s0 = n.s0 and o.s1 = n.s1 and o.i = -1 where n.i >= 0 group by n.accession, n.cls, n.s0, n.s1, o.m""")(
    lambda t: C.locus_percentile(t("v_span").transform(lambda s: C.intervals.merge_intervals(s, ["accession", "cls"])), t("v_track"))
)
RESIDUE = f"substr('{C.CODE}', cast(16 * (instr('{C.BASES}', {{0}}[1]) - 1) + 4 * (instr('{C.BASES}', {{0}}[2]) - 1) + instr('{C.BASES}', {{0}}[3]) as bigint), 1)"
query("codon_counts", f"""with p as (select a.doc_id, regexp_replace(upper(coalesce(a.text, '')), '[^ACGT-]', '', 'g') as x, regexp_replace(upper(coalesce(b.text, '')), '[^ACGT-]', '', 'g') as y from documents a join documents b on b.doc_id = a.doc_id + 1),
c as (select doc_id, x[i * 3 + 1 : i * 3 + 3] as c1, y[i * 3 + 1 : i * 3 + 3] as c2 from (select *, unnest(range(0, least(length(x), length(y)) // 3)) as i from p) z),
k as (select doc_id, {RESIDUE.format("c1")} = {RESIDUE.format("c2")} as same, (c1[1] <> c2[1])::int + (c1[2] <> c2[2])::int + (c1[3] <> c2[3])::int as d from c where not contains(c1, '-') and not contains(c2, '-')),
s as (select p.doc_id, max(least(length(x), length(y)) // 3) as l, count(k.doc_id) as codons, cast(coalesce(sum(d) filter (where same), 0) as bigint) as syn, cast(coalesce(sum(d) filter (where not same), 0) as bigint) as nonsyn, coalesce(count_if(not same), 0) as aa_diff from p left join k on k.doc_id = p.doc_id group by p.doc_id),
r as (select *, case when l >= 3 then nonsyn / greatest(codons * 2.25::double, 1e-9) end as dn, case when l >= 3 then syn / greatest(codons * 0.75::double, 1e-9) end as ds from s)
select doc_id, codons, syn, nonsyn, cast(aa_diff as bigint) as aa_diff, round(dn, 6) as dn, round(ds, 6) as ds, round(dn / greatest(ds, 1e-9), 6) as ratio from r""")(
    lambda t: C.codon_counts(t("documents").alias("a").join(t("documents").alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select("a.doc_id", F.col("a.text").alias("x"), F.col("b.text").alias("y")), "doc_id", "x", "y")
)
query("partial_f", """with g as (select block_id, count(*) as n, var_pop(label) * count(*) as yy, covar_pop(label, n_chars) * count(*) as xy, var_pop(n_chars) * count(*) as xx from v_manifest group by 1),
t as (select cast(sum(n) as bigint) as n, count(*) as g, sum(yy) as yy, sum(xy) as xy, sum(xx) as xx from g)
select n, cast(1 as int) as df1, n - g - 1 as df2, round(yy, 6) as rss_reduced, round(yy - xy * xy / xx, 6) as rss_full, round((xy * xy / xx) / ((yy - xy * xy / xx) / (n - g - 1) + 1e-12), 6) as f from t""")(
    lambda t: C.partial_f(t("v_manifest"), "label", ["n_chars"], "block_id").drop("p")
)
# Signs of components are free, so SQL cannot fix them; a test holds the scores against numpy.
query("pca_scores")(lambda t: C.pca_scores(t("v_emb"), "features", 4).select("vec_id", *[F.abs(F.col("scores")[i]).alias(f"pc{i + 1}") for i in range(4)]))
query(
    "known_locus_scores",
    f"""select * from ({ORACLES['locus_percentile']}) a join ({ORACLES['mass_enrichment']}) b using (accession, cls)
  join (select accession, cls, p from ({ORACLES['shift_null']}) z) c using (accession, cls)""",
)(lambda t: reports.known_locus_scores(t("v_track"), t("v_merged"), SHIFT_COUNT))
query(
    "known_locus_summary",
    f"""select accession % 3 as family, cls, count(distinct accession) as n_accessions, round(quantile_cont(enrichment, 0.5), 5) as median_enrichment,
  round(avg(enrichment), 5) as mean_enrichment, round(quantile_cont(percentile, 0.5), 5) as median_percentile, count_if(p < 0.05)::bigint as n_significant,
  round(count_if(p < 0.05) / count(*), 5) as frac_significant, count_if(percentile >= 0.9)::bigint as n_high from ({ORACLES['known_locus_scores']}) x group by 1, 2""",
)(lambda t: summary(t))


def summary(t):
    scores = reports.known_locus_scores(t("v_track"), t("v_merged"), SHIFT_COUNT)
    scores = scores.select("accession", "cls", *[F.round(c, 6).alias(c) for c in ("enrichment", "percentile", "p")])
    got = reports.known_locus_summary(scores, t("v_genome").select("accession", (F.col("accession") % 3).alias("family")))
    return got.select(*[F.round(c, 5).alias(c) if kind == "double" else F.col(c) for c, kind in got.dtypes])
