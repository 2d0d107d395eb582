"""Language identification by rank-order profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import uniform

#: Bits of a code point in an n-gram.
BITS = 21
_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol by code point: the letter's own code point, 0 for what is no letter."""
    if not _TABLE:
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _TABLE.append(np.where(letters, np.arange(0x110000), 0))
    return _TABLE[0]


def _ranked(text: str, symbols: np.ndarray, top: int | None):
    """The text's n-grams of two and three symbols, most frequent first (ties: by code), and their counts.

    Runs of non-letters count as one space. A code holds the code points, 21 bits each; the first of
    three is raised by one, so that every code of two is below. Returns None if the text has no letter.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols[points]
    if not s.any():
        return None
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    two = s[:-1] << BITS | s[1:]
    three = (two[:-1] + (1 << BITS)) << BITS | s[2:]
    grams = np.sort(np.concatenate((two, three)))
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    counts = np.diff(np.append(first, len(grams)))
    order = np.argsort(-counts, kind="stable")[:top]
    return grams[first][order], counts[order]


def train(docs: DataFrame, per_lang: int = 2000, top: int = 300, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict:
    """Profiles {langs, grams, ranks} from about per_lang documents of each language.

    The sample is documented and bounded: documents are kept by a hash of their id at the rate
    per_lang / number of documents of the language. Counting runs on Spark; what reaches the driver
    is the top n-grams of each language. Rows with null text or language teach nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return {"langs": [], "grams": np.zeros(0, np.int64), "ranks": np.zeros((0, 0), np.int64)}
    rate = F.element_at(F.create_map(*[F.lit(x) for k in sorted(n) for x in (k, min(1.0, per_lang / n[k]))]), F.col("lang"))
    sample = rows.where(uniform("id") < rate)

    def grams(batches):
        symbols = _symbols()
        for batch in batches:
            langs, all_codes, all_counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if got := _ranked(text, symbols, None):
                    langs += [lang] * len(got[0])
                    all_codes.append(got[0])
                    all_counts.append(got[1])
            join = lambda x: np.concatenate(x) if x else np.zeros(0)
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(join(all_codes).astype(np.int64)), pa.array(join(all_counts).astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profile = counted.withColumn("rank", rank - 1).where(F.col("rank") < top).select("lang", "gram", "rank").collect()
    langs = sorted({r["lang"] for r in profile})
    codes = np.unique(np.array([r["gram"] for r in profile], np.int64))
    ranks = np.full((len(langs), len(codes)), -1, np.int64)
    for r in profile:
        ranks[langs.index(r["lang"]), np.searchsorted(codes, r["gram"])] = r["rank"]
    return {"langs": langs, "grams": codes, "ranks": ranks}


def predict(docs: DataFrame, model: dict, top: int = 300, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred and score for every row.

    A document's top n-grams are compared to each profile by out-of-place distance: the sum of rank
    differences, and `top` for an n-gram that the profile lacks; the nearest profile wins (ties: the
    first language by name). score is the distance's lead over the second profile as a share of the
    second's, 1 with a single profile. Null texts, texts without a letter and an untrained model
    give `und` and 0. Whole texts are read, of any length; repeated rows each give a row.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        symbols, names = _symbols(), m["langs"]
        for batch in batches:
            said, scores = [], []
            for text in batch.column(len(keep)).to_pylist():
                got = _ranked(text, symbols, top) if text and names else None
                if got is None:
                    said.append("und")
                    scores.append(0.0)
                    continue
                at = np.searchsorted(m["grams"], got[0])
                at[at == len(m["grams"])] = 0
                known = m["grams"][at] == got[0]
                there = m["ranks"][:, at]
                far = np.where(known & (there >= 0), np.abs(there - np.arange(len(at))), top).sum(axis=1)
                order = np.argsort(far, kind="stable")
                said.append(names[order[0]])
                second = far[order[1]] if len(order) > 1 else 0
                scores.append(1.0 if len(order) == 1 else float((second - far[order[0]]) / second) if second else 0.0)
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, text_col).mapInArrow(run, f"{head}, lang_pred string, score double")
