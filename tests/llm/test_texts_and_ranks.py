"""License scans, ranked search and fill-in-middle against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqaudit.llm import fill_middle, licenses, ranked_search

ROWS = "doc_id bigint, text string, item_id string, rank string, score string, own string, words string, n string, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, texts):
    rows = [(i, t, *["clash"] * 7) for i, t in enumerate(texts)]
    rows += [(None, "null id the software", *[None] * 7), (7000, None, *["clash"] * 7), (7001, "twice the Work", *["clash"] * 7), (7001, "twice the Work", *["clash"] * 7)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def odd_texts():
    rng = random.Random(3)
    pool = "aZ09'_-.,!? \t\n\r\x0b\x0c\x1c\x7f\x85\xa0é日本語ßƒ²Ⅷ🙂​ 　Kİ"
    out = ["", " ", "\n\n", "a", "A", "<P>", "a<S>b", "x<M", "<<P", "x" * 500, "é" * 40, "Ab1Cd2"]
    return [*out, *["".join(rng.choice(pool) for _ in range(rng.randrange(1, 80))) for _ in range(200)], " ".join(rng.choice(["alpha", "Beta!", "日本", "<", "P>"]) for _ in range(60_000))]


def test_skip_list_counts_as_a_running_sum():
    for text in odd_texts():
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
        own = fill_middle.SkipList(text)
        edges = np.append(0, np.cumsum([len(u) for u in units])).astype(int)
        assert own.n == len(units)
        for rank in range(0, own.n + 1, max(1, own.n // 50)):
            assert own.points(rank) == edges[rank]
    own = fill_middle.SkipList("a " * 50_000)
    assert len(own.lanes) > 4 and all(lane[0].sum() == 100_000 and lane[1].sum() == 100_000 for lane in own.lanes)
    assert all(4 < len(a[0]) / len(b[0]) < 16 for a, b in zip(own.lanes, own.lanes[1:], strict=False) if len(a[0]) > 1000)


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_is_brute_force(spark):
    docs = frame(spark, odd_texts())
    got = fill_middle.transform(docs, keep=("doc_id", "text")).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count() and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_by_hand(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_marks_made_at_a_cut_do_not_mislead(spark):
    texts = ["<" * k + "S>M>P" * j + "<" * k for k in range(4) for j in range(1, 4)] * 3
    got = fill_middle.transform(frame(spark, texts), plain_percent=0, keep=("text",)).withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
    assert got.where("again <> coalesce(text, '')").isEmpty()


def ranked_by_hand(docs, items, k):
    tokens = [(i, WORD.findall(low(t))) for i, t in docs]
    n, total = sum(bool(w) for _, w in tokens), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    out = set()
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(WORD.findall(low(text)))
    for item, own in wanted.items():
        scores = []
        for i, w in tokens:
            tf = Counter(w)
            m = 50 + (50 * len(w) * n) // total if w else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize(("k", "block"), [(5, 250_000), (50, 40)])
def test_ranked_search_is_brute_force(spark, k, block):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(1, 60))) for _ in range(400)]
    texts += [texts[0]] * 80 + ["W1, w2\x00w3_É w1", "é É", "", " \n"] + ["w59 " * 3000]
    docs = frame(spark, texts)
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(40)] + [(3, "w1 w1 w59"), (None, "w2"), (99, None), (98, "absent"), (97, "É")]
    queries = spark.createDataFrame([(*x, "clash", "clash") for x in items], "item_id int, text string, doc_id string, id string")
    got = {tuple(r) for r in ranked_search.rank(docs, queries, k=k, block_terms=block).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == ranked_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], items, k)
    assert ranked_search.rank(docs.limit(0), queries).count() == 0 and ranked_search.rank(docs, queries.limit(0)).count() == 0


def test_pairs_of_nodes_are_pruned():
    rng = np.random.default_rng(2)
    groups = np.repeat(np.arange(40), 100)
    coords = np.sort(np.concatenate([rng.choice(25, (4000, 6)).T % 25 + groups * 25]).T, axis=1)
    coords = [np.unique(c) for c in coords]
    offsets = np.append(0, np.cumsum([len(c) for c in coords]))
    values = rng.integers(1, 1000, offsets[-1])
    ids, docs = ranked_search._doc_tree(np.arange(4000), offsets, np.concatenate(coords), values)
    items = ranked_search.Items(np.arange(0, 161, 4), (np.arange(40)[:, None] * 25 + np.arange(4)).ravel(), np.full(160, 7), np.float64)
    best = ranked_search.Best(40, 10, np.float64)
    pairs = ranked_search.descend(items, docs, ids, best)
    assert pairs < 0.5 * (4000 / ranked_search.DOCS) * (40 / ranked_search.ITEMS)
    for i in range(40):
        scores = sorted((-7 * sum(v for c, v in zip(coords[d], values[offsets[d] : offsets[d + 1]], strict=True) if i * 25 <= c < i * 25 + 4), d) for d in range(4000))
        assert [(-s, d) for s, d in scores[:10] if s < 0] == [(s, d) for s, d in zip(best.scores[i], best.ids[i], strict=True) if s > 0]


def test_terms_come_in_pieces():
    text = low("Ab cd," * 1000).encode()
    assert [w for x in ranked_search.terms(text, piece=7) for w in x] == [w.encode() for w in WORD.findall(text.decode())]


def scanned_by_hand(texts, rarest=8, share=0.75):
    splits = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for t in texts]
    df = Counter(w for s in splits for w in set(s))
    idf = lambda w: math.log(1 + len(texts) / (1 + df[w]))
    out = []
    for own in splits:
        at = lambda o, parts, own=own: o >= 0 and own[o : o + len(parts)] == parts
        base = sorted((i, label) for label, p in licenses.PHRASES for i in range(len(own)) if at(i, p.split()))
        found = {label: 1.0 for _, label in base}
        for label, text, keys in licenses.TEMPLATES:
            words = text.split()
            order = sorted(set(words), key=lambda w: (-idf(w), w))
            total = sum(idf(w) for w in words if w in order[:rarest])
            looked = [w for w in order if w in own][:rarest]
            spots: Counter = Counter()
            for i, w in enumerate(own):
                for p, x in enumerate(words):
                    if w == x and w in looked:
                        spots[i - p] += idf(w)
            for o, s in spots.items():
                part = min(1.0, round(s / total, 6))
                if part >= share and all(at(o + " ".join(words).split().index(k.split()[0], next(j for j in range(len(words)) if words[j : j + len(k.split())] == k.split())), k.split()) for k in keys):
                    found[label] = max(found.get(label, 0), part)
        out.append((len(own), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(found)), max(found.values(), default=0.0)))
    return out


def test_license_scan_is_brute_force(spark):
    rng = random.Random(8)
    filler = [f"word{i}" for i in range(30)] + ["the", "of", "license", "software"]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [some(40) for _ in range(30)] + ["Under the MIT License: cc-by-nc", "cc by nc cc by nc 4.0", "under the mitİ license", "Apache License,\n Version 2.0"]
    for _, text, _ in licenses.TEMPLATES:
        words = text.split()
        texts.append(f"{some(7)} {', '.join(words).title()} {some(5)}")
        texts.append(" ".join(w if rng.random() > 0.2 else "changed" for w in words))
        texts.append(" ".join(rng.sample(words, len(words))))
        texts.append(" ".join(words[: len(words) // 2] + ["inserted"] + words[len(words) // 2 :]))
    texts.append((licenses.TEMPLATES[5][1] + " ") * 3000)
    docs = frame(spark, [*odd_texts()[:60], *texts])
    got = licenses.scan(docs, licenses.word_weights(docs), keep=("text",)).collect()
    wanted = scanned_by_hand([r["text"] for r in got])
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [tuple(r[c] for c in cols[:-1]) for r in got] == [w[:-1] for w in wanted]
    assert [r["score"] for r in got] == pytest.approx([w[-1] for w in wanted], abs=2e-6)
    assert {x for r in got for x in r["labels"].split(",")} >= {label for label, _, _ in licenses.TEMPLATES}
    assert licenses.scan(docs.limit(0), licenses.word_weights(docs.limit(0))).count() == 0


def test_license_scan_stays_in_the_jvm(spark):
    docs = frame(spark, ["x"])
    plan = licenses.scan(docs, licenses.word_weights(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
