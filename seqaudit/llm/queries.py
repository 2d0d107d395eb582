"""Queries of this subpackage, over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontamination, fill_middle, jaccard_join, language_id, licenses, quality, ranked_search, secrets, token_counts, toxicity, url_filters
from .common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out("doc_id")))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.transcripts(chat.linked(table(spark, sf_dir, "conversations")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs), with_text=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out("doc_id")))
    return language_id.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *quality.STATS, "base_failed", "kept")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filters.train(url_filters.labelled(spark))
    return url_filters.judge(table(spark, sf_dir, "pages"), model).select("page_id", "host", "path", "rule", "verdict")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.word_weights(docs)).drop("found")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fill_middle.transform(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_byte_bpe,
        op3_jaccard_join,
        op4_chat_formatting,
        op5_secret_scans,
        op6_language_id,
        op7_token_counts,
        op8_decontamination,
        op9_quality_rules,
        op10_url_filters,
        op11_license_scans,
        op12_ranked_search,
        op13_fill_middle,
    )
}

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_jaccard_join": r"""
with recursive w as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from w),
one as (select doc_id, len(s) as n, unnest(s) as g from sets where len(s) > 0),
two as (select g from one group by g having count(*) > 1),
hit as (select o.* from one o join two using (g)),
links as (
  select a.doc_id as a, b.doc_id as b from hit a join hit b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))),
reach as (
  select doc_id as a, doc_id as c from sets
  union
  select l.b as a, r.c from reach r join links l on l.a = r.a where r.c < l.b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.c) as component_id
from sets s join reach r on r.a = s.doc_id group by s.doc_id, len(s.s)
""",
    "op11_license_scans": licenses.oracle(),
    "op12_ranked_search": rf"""
with toks as (select doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
total as (select cast(count_if(len(w) > 0) as bigint) as n_docs, cast(sum(len(w)) as bigint) as n_terms from toks),
item as (select distinct item_id, unnest(regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
tf as (select doc_id, any_value(n) as n, t, count(*) as tf from (select doc_id, cast(len(w) as bigint) as n, unnest(w) as t from toks) where t in (select t from item) group by doc_id, t),
weight as (select t, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, total group by t),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) as bigint) as score
  from tf join item using (t) join weight using (t), total group by item_id, doc_id),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 50
""",
    "op13_fill_middle": r"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as h from documents),
numbers as (
  select *, cast(len(u) as bigint) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from numbers),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cut)
select doc_id, n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
""",
}
