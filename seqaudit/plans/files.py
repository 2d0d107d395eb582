"""Queries of the readers and writers: given tables are written to files, read back and compared with SQL on the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .fixtures import ctes, view
from .registry import ORACLES, QUERIES


def folder(spark: SparkSession) -> str:
    """A new folder where executors and driver meet: under spark.checkpoint.dir, or a temporary one in a local session without it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/files-{uuid.uuid4().hex}"


def query(name: str, sql: str):
    """Register a query given a function of (spark, folder, table getter)."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = build(spark, folder(spark), lambda table: view(spark, sf_dir, table))
            return got.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])

        run.__name__ = name
        QUERIES[name], ORACLES[name] = run, ctes(sql)
        return build

    return add


@query("scan_manifest", "select doc_id, lang, source, n_chars from documents")
def _manifest(spark, path, t):
    t("documents").select("doc_id", "lang", "source", "n_chars").write.option("header", True).option("sep", "\t").csv(f"{path}/manifest.tsv")
    return files.scan_manifest(spark, f"{path}/manifest.tsv", "doc_id bigint, lang string, source string, n_chars bigint")


@query("scan_tracks", "select cast(accession as varchar) as accession, pos, round(abs(attr), 6) as attr from v_track")
def _tracks(spark, path, t):
    track = t("v_track").select("accession", F.col("pos").alias("genomic_pos"), F.col("attr").alias("attr_score"))
    files.write_by_key(track, f"{path}/tracks", "accession", "stitched_attr.csv")
    return files.scan_tracks(spark, f"{path}/tracks/*.csv")


@query("scan_sequences", "select 'AC_' || doc_id as accession, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as sequence from documents where text is not null and text <> ''")
def _sequences(spark, path, t):
    body = F.regexp_replace("text", "[^A-Za-z]", "")
    record = F.concat(F.lit(">lineage x|AC_"), F.col("doc_id"), F.lit(" whole\n"), F.regexp_replace(body, "(.{70})", "$1\n"))
    t("documents").where("text is not null and text <> ''").select(record).write.text(f"{path}/sequences.fasta")
    return files.scan_sequences(spark, f"{path}/sequences.fasta")


@query("scan_annotations", "select 'AC_' || accession as accession, 'CDS' as ftype, cast(s0 as bigint) as s0, cast(s1 as bigint) as s1, lower(cls) as label, 'g' || s0 as gene, lower(cls) as product from v_span where s1 > s0")
def _annotations(spark, path, t):
    place = F.concat(F.col("s0") + 1, F.lit(".."), F.col("s1"))
    place = F.when(F.col("s0") % 2 == 0, F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(F.concat(F.lit("join("), place, F.lit(",\n" + " " * 21 + "9)")))
    feature = F.concat(F.lit("     CDS             "), place, F.lit("\n" + " " * 21 + '/gene="G'), F.col("s0"), F.lit('"\n' + " " * 21 + '/product="'), F.upper("cls"), F.lit('"'))
    spans = t("v_span").where("s1 > s0").groupBy("accession").agg(F.array_join(F.array_sort(F.collect_list(feature)), "\n").alias("body"))
    record = F.concat(F.lit("LOCUS       AC_"), F.col("accession"), F.lit(" 100 bp\nFEATURES             Location/Qualifiers\n     source          1..100\n"), F.col("body"), F.lit("\nORIGIN\n        1 acgt\n//"))
    spans.select(record).write.text(f"{path}/annotations")
    return files.scan_annotations(spark, f"{path}/annotations")


@query("write_results", "select 'csv' as format, count(*) as n, sum(n_chars) as total from documents union all select 'json', count(*), sum(n_chars) from documents union all select 'parquet', count(*), sum(n_chars) from documents")
def _results(spark, path, t):
    out = None
    for fmt in ("csv", "json", "parquet"):
        files.write_results(t("documents").select("doc_id", "lang", "n_chars"), f"{path}/{fmt}", fmt)
        back = spark.read.format(fmt).schema("doc_id bigint, lang string, n_chars bigint").option("header", True).load(f"{path}/{fmt}")
        got = back.agg(F.count("*").alias("n"), F.sum("n_chars").alias("total")).select(F.lit(fmt).alias("format"), "n", "total")
        out = got if out is None else out.unionByName(got)
    return out


@query("write_nulls", "select cls, count(*) as n, cast(sum(s1 - s0) as bigint) as total from v_span group by 1")
def _nulls(spark, path, t):
    files.write_nulls(t("v_span"), f"{path}/nulls")
    return spark.read.parquet(f"{path}/nulls").groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.col("s1") - F.col("s0")).cast("bigint").alias("total"))


@query("hash_manifest", """with f as (select cast(p_size as varchar) as name, string_agg(cast(p_partkey as varchar), chr(10) order by p_partkey) || chr(10) as content from part group by 1)
select name || '.txt' as name, case when name = '3' then 'changed' when name = '5' then 'extra' else 'ok' end as status, sha256(content) as found_sha256, cast(length(content) as bigint) as found_bytes from f union all select 'none.txt', 'missing', null, null""")
def _hashes(spark, path, t):
    own = t("part").select("p_size", F.col("p_partkey").cast("string").alias("line"))
    files.write_lines_by_key(own, f"{path}/hashed", "p_size", "txt")
    content = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("line").cast("bigint"))), lambda x: x.cast("string")), "\n"), F.lit("\n"))
    locked = own.groupBy("p_size").agg(content.alias("c")).where("p_size <> 5").select(F.concat("p_size", F.lit(".txt")).alias("name"), F.when(F.col("p_size") == 3, "0").otherwise(F.sha2("c", 256)).alias("sha256"), F.length("c").cast("bigint").alias("bytes"))
    locked = locked.unionByName(spark.sql("select 'none.txt' as name, '1' as sha256, cast(1 as bigint) as bytes"))
    return files.hash_manifest(spark, f"{path}/hashed/*.txt", locked).select("name", "status", "found_sha256", "found_bytes")
