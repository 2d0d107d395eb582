"""URL filters: host and path rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import csv
import io
import pkgutil

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path) as fixed by the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The labelled table that comes with the package: label (1 is to be blocked) and url.
LABELS = "url_labels.csv"


def labelled(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(url, label) of a small labelled CSV table, by default the package's own; 1 is to be blocked."""
    text = open(path, encoding="utf8").read() if path else pkgutil.get_data(__package__, LABELS).decode()
    rows = [(r["url"], float(r["label"])) for r in csv.DictReader(io.StringIO(text))]
    return spark.createDataFrame(rows, "url string, label double")


def host(url: Column) -> Column:
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules, host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """The longest fitting rule, as text (host and path without the final slash's host dot), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        own, under = F.col(host_col) == h, F.col(host_col).endswith("." + h)
        fits = (own | under) & F.col(path_col).startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def grams(host_col: Column, path_col: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of host and path, each part marked so that they do not mix."""
    parts = []
    for mark, part in (("h", F.concat(F.lit("^"), host_col, F.lit("$"))), ("p", F.concat(F.lit("^"), path_col, F.lit("$")))):
        for n in range(low, high + 1):
            spots = F.when(F.length(part) >= n, F.sequence(F.lit(1), F.length(part) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(_cut(spots, part, n, mark))
    return F.concat(*parts)


def _cut(spots: Column, part: Column, n: int, mark: str) -> Column:
    return F.transform(spots, lambda i: F.concat(F.lit(mark), F.substring(part, i, F.lit(n))))


def train(table: DataFrame, buckets: int = 1 << 14, url_col: str = "url", label_col: str = "label") -> tuple[HashingTF, LogisticRegressionModel] | None:
    """Fit on the labelled table, which is small by definition; rows with null label are left out. Without both labels there is no model (None)."""
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True)
    rows = table.where(F.col(label_col).isNotNull()).select(host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.col(label_col).cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    rows = hashed.transform(rows.select(grams(F.col("host"), F.col("path")).alias("grams"), "label"))
    return hashed, LogisticRegression(regParam=0.01, maxIter=60, featuresCol="features", labelCol="label").fit(rows.coalesce(1))


def judge(pages: DataFrame, model, rules=RULES, threshold: float = 0.5, url_col: str = "url", keep=("page_id",)) -> DataFrame:
    """The columns in keep, host, path, rule, verdict and p_block for every row.

    The longest fitting rule decides; elsewhere the model blocks from the threshold on, and without a model all is allowed. A url that is
    null or has no `://` has an empty host and path and no rule; the model judges it by what it gives a url without n-grams. Repeated rows each give a row; an empty table gives an empty result; other
    columns are not read, so clashing names do no harm.
    """
    rows = pages.select(F.struct(*keep).alias("own"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    scored, p = rows, F.lit(0.0)
    if model is not None:
        hashed, fitted = model
        scored = fitted.transform(hashed.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))))
        p = vector_to_array("probability")[1]
    name, verdict = rule_of(rules)
    scored = scored.select("own", "host", "path", name.alias("rule"), verdict.alias("said"), p.alias("p_block"))
    said = F.coalesce("said", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return scored.select(*[F.col(f"own.{k}").alias(k) for k in keep], "host", "path", "rule", said.alias("verdict"), "p_block")
