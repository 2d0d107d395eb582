"""License scans: a positional index of the rare words of license texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: ASCII characters that are neither digits nor small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (label, phrase) as fixed by the contract.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Fixed values: (label, words of a published notice or grant, key phrases of it that must stand there too).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["deal in the software without restriction"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["used to endorse or promote products"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2 of the license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["commons attribution 4 0 international"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]


def words(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BETWEEN), "")  # ten times as fast as regexp_extract_all


def vocabulary(templates=TEMPLATES) -> list[str]:
    """All words of the templates and of the contract's phrases; a vocabulary over 20,000 words would be too large for a literal."""
    known = sorted({w for _, text, _ in templates for w in text.split()} | {w for _, p in PHRASES for w in p.split()})
    if len(known) > 20_000:
        raise ValueError("the templates have over 20,000 words")
    return known


def _texts(values: list[str]) -> str:
    """An SQL array; templates hold words only, so nothing needs quoting."""
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def word_weights(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency, over all rows, of each word of the templates: ln(1 + N / (1 + df))."""
    known = vocabulary(templates)
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(F.expr(_texts(known)), words(F.col(text_col))))).alias("w"))
    df = dict(held.groupBy("w").count().collect())  # a row a word of the vocabulary
    n = df.get("", 0)
    return {w: math.log(1 + n / (1 + df.get(w, 0))) for w in known}


def _index(weights: dict[str, float], templates, rarest: int) -> Column:
    """The templates as one literal: label, own words by falling weight, the weight of the rarest, postings (word, place, weight) and key phrases."""
    out = []
    for label, text, keys in templates:
        own = text.split()
        ranked = sorted(set(own), key=lambda w: (-weights[w], w))
        total = sum(weights[w] for w in own if w in ranked[:rarest])
        posts = ", ".join(f"named_struct('w', '{w}', 'p', {i}, 'x', {weights[w]!r}D)" for i, w in enumerate(own))
        said = ", ".join(f"named_struct('p', {_place(own, key.split())}, 'words', {_texts(key.split())})" for key in keys)
        need = sorted({w for key in keys for w in key.split()}, key=lambda w: (-weights[w], w))
        out.append(f"named_struct('label', '{label}', 'ranked', {_texts(ranked)}, 'need', {_texts(need)}, 'total', {total!r}D, 'posts', array({posts}), 'keys', array({said}))")
    return F.expr(f"array({', '.join(out)})")


def _place(own: list[str], parts: list[str]) -> int:
    return next(i for i in range(len(own)) if own[i : i + len(parts)] == parts)


def _stands(all_words: Column, at: Column, phrase: Column) -> Column:
    return (at >= 0) & (F.slice(all_words, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)


def _agreement(t: Column, all_words: Column, own: Column, rarest: int, share: float) -> Column:
    """The largest share of a template's rare weight that agrees on one relative position where its key phrases stand; 0 below `share`."""
    looked = F.slice(F.array_intersect(t["ranked"], own), 1, rarest)
    spots = F.filter(F.transform(all_words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(looked, s["w"]))
    met = F.transform(spots, lambda s: F.transform(F.filter(t["posts"], lambda p: p["w"] == s["w"]), lambda p: F.struct((s["i"] - p["p"]).alias("o"), p["x"].alias("x"))))
    ends = F.array(F.struct(F.lit(None).cast("int").alias("o"), F.lit(0.0).alias("x")))
    met = F.concat(F.sort_array(F.flatten(met)), ends)
    start = F.struct(F.lit(None).cast("int").alias("o"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(acc, m):
        part = F.least(F.lit(1.0), F.round(acc["s"] / t["total"], 6))
        whole = (part >= share) & F.forall(t["keys"], lambda k: _stands(all_words, acc["o"] + k["p"], k["words"]))
        same = acc["o"] == m["o"]
        closed = F.when(acc["o"].isNotNull() & (part > acc["best"]) & whole, part).otherwise(acc["best"])
        return F.when(F.coalesce(same, F.lit(False)), F.struct(m["o"].alias("o"), (acc["s"] + m["x"]).alias("s"), acc["best"].alias("best"))).otherwise(F.struct(m["o"].alias("o"), m["x"].alias("s"), closed.alias("best")))

    return F.aggregate(met, start, step)["best"]


def scan(docs: DataFrame, weights: dict[str, float], templates=TEMPLATES, rarest: int = 8, share: float = 0.75, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns in keep, n_words, n_base, first_word, last_word, base_labels, labels, score, and found (label and share of each template met).

    Base phrases count wherever their words stand consecutively. A text gets a template's label if, of the weight of the template's
    `rarest` words, a share agrees on one relative position among the places of the text's highest-weighted words of that template,
    and its key phrases stand at that position. A row is judged alone, with no shuffle, from `word_weights`, which are counted over all
    rows. score is the largest share, 1 with a base phrase, 0 without any label. Null and empty texts have no words, no labels (an empty
    string) and score 0; equal shares keep all their labels; repeated rows each give a row; an empty table gives an empty result;
    other columns are not read.
    """
    rows = docs.select(F.struct(*keep).alias("own"), words(F.col(text_col)).alias("words"))
    rows = rows.select("own", "words", F.array_intersect(F.expr(_texts(vocabulary(templates))), F.col("words")).alias("known"))
    spots = []
    for label, phrase in PHRASES:
        parts = phrase.split()
        every = F.transform("words", lambda w, i: F.when(w == parts[0], i))  # noqa: B023
        places = F.filter(every, lambda i: i.isNotNull() & _stands(F.col("words"), i, F.expr(_texts(parts))))  # noqa: B023
        there = F.forall(F.expr(_texts(parts)), lambda w: F.array_contains("known", w))
        spots.append(F.when(there, places).otherwise(F.array().cast("array<int>")).alias(label))
    likely = F.filter(_index(weights, templates, rarest), lambda t: F.forall(t["need"], lambda w: F.array_contains("known", w)))
    rows = rows.select("own", "words", "known", *spots, likely.alias("likely"))
    met = F.transform("likely", lambda t: F.struct(t["label"].alias("label"), _agreement(t, F.col("words"), F.col("known"), rarest, share).alias("share")))
    rows = rows.select("own", F.size("words").cast("bigint").alias("n_words"), *[x for x, _ in PHRASES], F.filter(met, lambda f: f["share"] > 0).alias("found"))
    places = F.concat(*[F.col(f"`{x}`") for x, _ in PHRASES])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(F.col(f"`{x}`")) > 0, F.lit(x)) for x, _ in PHRASES])))
    score = F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda f: f["label"]))))
    return rows.select("own.*", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "found")


def oracle(templates=TEMPLATES, rarest: int = 8, share: float = 0.75) -> str:
    """The same in SQL, by joins on a table `documents` whose doc_id is unique."""
    rows = ", ".join(f"({t}, '{label}', '{w}', {i})" for t, (label, text, _) in enumerate(templates) for i, w in enumerate(text.split()))
    keys = []
    for t, (_, text, phrases) in enumerate(templates):
        own = text.split()
        for n, key in enumerate(phrases):
            parts = key.split()
            at = _place(own, parts)
            keys += [f"({t}, {n}, '{w}', {at + j})" for j, w in enumerate(parts)]
    base = ", ".join(f"('{label}', '{p}', {len(p.split())})" for label, p in PHRASES)
    return f"""
with tpl(t, label, w, p) as (values {rows}), key(t, k, w, p) as (values {", ".join(keys)}), phrase(label, said, n) as (values {base}),
vocab as (select distinct w from tpl union select distinct unnest(string_split(said, ' ')) from phrase),
doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN.replace('[', '[^')}') as words from documents),
pos as (select doc_id, unnest(words) as w, unnest(range(0, len(words))) as i from doc),
own as (select distinct doc_id, w from pos where w in (select w from vocab)),
idf as (select w, ln(1 + (select count(*) from documents) / (1.0 + count(doc_id))) as x from vocab left join own using (w) group by w),
words_of as (select distinct t, w from tpl),
ranked as (select t, w, x, row_number() over (partition by t order by x desc, w) as r from words_of join idf using (w)),
total as (select t, sum(x) as total from tpl join ranked using (t, w) where r <= {rarest} group by t),
need as (select distinct t, w from key),
likely as (select doc_id, t from own join need using (w) group by doc_id, t having count(*) = (select count(*) from need n where n.t = any_value(need.t))),
looked as (select doc_id, t, w, x, row_number() over (partition by doc_id, t order by x desc, w) as r from likely join ranked using (t) join own using (doc_id, w)),
met as (select l.doc_id, l.t, s.i - q.p as o, sum(l.x) as s from looked l join pos s using (doc_id, w) join tpl q on q.t = l.t and q.w = l.w where l.r <= {rarest} group by 1, 2, 3),
good as (select doc_id, t, o, least(1.0, round(s / total, 6)) as share from met join total using (t)),
stood as (select g.doc_id, g.t, g.o, any_value(g.share) as share from good g join key k using (t) join pos s on s.doc_id = g.doc_id and s.i = g.o + k.p and s.w = k.w
  where g.share >= {share} group by 1, 2, 3 having count(*) = (select count(*) from key c where c.t = g.t)),
found as (select doc_id, label, max(share) as share from stood join (select distinct t, label from tpl) using (t) group by 1, 2),
base as (select doc_id, label, i from pos join phrase on w = string_split(said, ' ')[1] join doc using (doc_id) where words[i + 1:i + n] = string_split(said, ' ')),
sums as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id),
every as (select doc_id, label, share from found union all select doc_id, label, 1.0 from base),
marks as (select doc_id, string_agg(distinct label, ',' order by label) as labels, max(share) as score from every group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(score, 0.0) as double) as score
from doc left join sums using (doc_id) left join marks using (doc_id)
"""
