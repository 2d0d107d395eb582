"""Each stage of the pipeline against a brute-force version on one small table."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from seqaudit.llm import byte_bpe
from tests.llm.test_operators import brute_components, brute_leaks, brute_secrets, brute_sets, brute_statistics

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"{rng.choice(['stone', 'river', 'cloud', 'field'])}{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(25)) for i in range(4)]
    texts = [say(rng.randrange(60, 200)) for _ in range(80)]
    texts += [t.replace(" ", " extra ", 1) for t in texts[:10]] + [f"{say(60)} {items[i][1]} {say(60)}" for i in range(4)]
    texts += [f'{say(60)} token = "{"0123456789abcdef" * 2}" {say(20)}' for _ in range(6)] + ["short", "", None, texts[0]] + [say(100).replace(" ", " ### $$$ ") for _ in range(4)]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)] + [(None, say(100), "en", "a", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages(spark, corpus, tmp_path):
    folder, rows, items = corpus
    docs, kept, last = spark.read.parquet(f"{folder}/documents.parquet"), {r[0]: r for r in rows}, None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if n < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / str(n)))
            docs = spark.read.parquet(str(tmp_path / str(n)))
            got = {r["doc_id"]: tuple(r) for r in docs.collect()}
        if n == 0:
            assert {i for i, r in kept.items() if brute_statistics(r[1])[0] < 50} & {*got} == set()
            assert not any("###" in r[1] for r in got.values()) and len(got) == len(rows) - 3 - 4
        elif n == 1:
            ids = [i for i in kept if i is not None]
            root = brute_components(ids, brute_sets([kept[i][1] for i in ids], 5), 80)
            assert {*got} == {i for i in ids if root[i] == i} | {None}
        elif n == 2:
            bad = {i for i, _ in brute_leaks([(i, r[1]) for i, r in kept.items()], items)}
            assert bad and {*got} == {*kept} - bad
        elif n == 3:
            assert {*got} == {*kept} and sum("[SECRET]" in r[1] for r in got.values()) == sum(bool(brute_secrets(r[1])) for r in kept.values()) > 0
            assert not any(brute_secrets(r[1]) for r in got.values()) and all(r[4] == len(r[1]) for r in got.values())
        kept = got
        last = out
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: len(own.encode_ordinary(r[1])) for i, r in kept.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in last.collect()} == want
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()} == want
