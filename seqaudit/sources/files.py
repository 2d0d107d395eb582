"""Readers and writers of manifests, tracks, sequences and results."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_manifest(spark: SparkSession, path: str, schema: str, sep: str | None = None) -> DataFrame:
    """A delimited table with a header; tabs by extension (.tsv, .txt) unless sep is given."""
    tabs = path.rstrip("/").lower().removesuffix(".gz").endswith((".tsv", ".txt"))
    return spark.read.csv(path, schema=schema, header=True, sep=sep or ("\t" if tabs else ","))


def scan_pruned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a Parquet table; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def resolve_columns(df: DataFrame, wanted: dict[str, str | None], aliases: dict[str, list[str]]) -> DataFrame:
    """Rename to each key of wanted the column asked for, else the first alias there; blanks around names are ignored."""
    there = {c.strip(): c for c in reversed(df.columns)}
    for name, asked in wanted.items():
        found = next((there[c] for c in ([asked] if asked else aliases.get(name, [])) if c in there), None)
        if found is None:
            raise ValueError(f"no column for {name}")
        df = df.withColumnRenamed(found, name)
    return df


def scan_tracks(spark: SparkSession, glob: str) -> DataFrame:
    """(accession, pos, attr) of many track files; the accession is the file's name up to its first dot.

    attr is attr_abs_mean, else the absolute attr_score. What is no number is null; rows without a position go.
    """
    raw = _with_header(spark, glob)
    known = [F.col("attr_abs_mean").try_cast("double")] * ("attr_abs_mean" in raw.columns) + [F.abs(F.col("attr_score").try_cast("double"))] * ("attr_score" in raw.columns)
    return raw.select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("accession"), F.col("genomic_pos").try_cast("int").alias("pos"), F.coalesce(*known).alias("attr")).where("pos is not null")


def _with_header(spark: SparkSession, glob: str) -> DataFrame:
    """Delimited files with a header; names that match a pattern in one folder come from a listing of it, as each path of an expanded pattern would be listed anew."""
    folder, _, names = glob.rpartition("/")
    own = spark.read.option("pathGlobFilter", names)
    there = None
    if folder and re.search(r"[*?\[{]", names) and not re.search(r"[*?\[{]", folder):
        there = own.text(folder).where("trim(value) <> ''").first()
    if not there:
        return spark.read.option("header", True).csv(glob)
    cols = spark.read.option("header", True).csv(spark.sparkContext.parallelize([there.value], 1)).schema
    return own.schema(cols).option("header", True).csv(folder)


def accession(header: Column) -> Column:
    """The first |-separated part whose first word has a digit, 20 letters at most and no nt at its end; else the first word."""
    words = F.transform(F.split(header, r"\|"), lambda t: F.split(F.trim(t), " ")[0])
    fit = F.filter(words, lambda w: w.rlike("[0-9]") & (F.length(w) <= 20) & ~w.endswith("nt"))
    return F.coalesce(F.get(fit, F.lit(0)), F.split(F.trim(header), " ")[0])


def scan_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(accession, sequence) of FASTA files, one row a record."""
    records = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    parts = F.split("value", r"\r?\n", 2)
    return records.select(accession(parts[0]).alias("accession"), F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")).alias("sequence"))


#: Kinds of features that become spans. Fixed values of the annotation format.
KINDS = ("CDS", "mat_peptide", "Region", "gene")


def scan_annotations(spark: SparkSession, glob: str) -> DataFrame:
    """(accession, ftype, s0, s1, label, gene, product) of annotation flat files, a row for each part of a feature's location.

    Records end with a line of two slashes; the accession is the first word of a record's LOCUS line, else the file's name without its
    extension. Parts a..b, joined or complemented, become [a - 1, b); what is no such part is left out. The label is the region's name, else
    the product, else the gene, in lower case as these are; names are empty where absent. All of it is column expressions on the executors.
    """
    records = spark.read.option("lineSep", "\n//").text(glob).select(F.regexp_replace("value", "\r", "").alias("r"), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("file"))
    locus = F.regexp_extract("r", r"(?m)^LOCUS +(\S+)", 1)
    blocks = records.select(F.coalesce(F.nullif(locus, F.lit("")), "file").alias("accession"), F.explode(F.split("r", r"\n(?= {5}\S)")).alias("b"))
    named = lambda field: F.lower(F.coalesce(F.try_element_at(F.regexp_extract_all("b", F.lit(rf'\n {{21}} */{field}="([^"\n]*)'), 1), F.lit(-1)), F.lit("")))
    place = F.regexp_replace(F.regexp_extract("b", r"^ {5}\S+\s+([^\n]*(?:\n {21} *[^/\s][^\n]*)*)", 1), r"\s", "")
    own = blocks.select("accession", F.regexp_extract("b", r"^ {5}(\S+)\s+\S", 1).alias("ftype"), place.alias("place"), named("region_name").alias("region"), named("product").alias("product"), named("gene").alias("gene")).where(F.col("ftype").isin(*KINDS))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "").try_cast("bigint")
    parts = F.transform(F.filter(F.split("place", ","), lambda x: x.contains("..")), lambda x: F.struct((digits(F.substring_index(x, "..", 1)) - 1).alias("s0"), digits(F.regexp_extract(x, r"\.\.(.*)$", 1)).alias("s1")))
    label = F.coalesce(F.nullif("region", F.lit("")), F.nullif("product", F.lit("")), "gene")
    return own.select("accession", "ftype", F.inline(parts), label.alias("label"), "gene", "product").where("s0 >= 0 and s1 > s0")


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result as parquet, csv (with a header) or json."""
    df.write.mode("overwrite").options(**({"header": True} if fmt == "csv" else {})).format(fmt).save(path)


def write_by_key(df: DataFrame, path: str, key: str, extension: str = "csv") -> None:
    """One delimited file with a header a key, named by it, as readers that tell the key from the file's name expect.

    Rows of a key are gathered in one file, so a key is what one such file may hold.
    """
    cols = [c for c in df.columns if c != key]
    head = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in cols]))).first()[0]
    _one_file_a_key(df.select(key, F.to_csv(F.struct(*cols)).alias("line")).repartition(key).sortWithinPartitions(key), path, key, extension, f"{head}\n")


def write_lines_by_key(df: DataFrame, path: str, key: str, extension: str = "txt") -> None:
    """One text file a key with the numbers of the column `line` in order, a line each."""
    rows = df.select(key, F.coalesce("line", F.lit("")).alias("line"))
    _one_file_a_key(rows.repartition(key).sortWithinPartitions(key, F.col("line").try_cast("bigint")), path, key, extension, "")


def _one_file_a_key(rows: DataFrame, path: str, key: str, extension: str, head: str) -> None:
    """Write (key, line), whose keys lie together in a task, to files named by the key, with characters escaped as in names of partition folders.

    Tasks write the files under their last names, so nothing is left for the driver to do file by file. A file comes under another name and is
    moved when it is whole, so a task may run twice.
    """
    folder = f"file:{path}" if path.startswith("/") else path
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))

    def write(batches):
        from pyspark import TaskContext

        store, top = FileSystem.from_uri(folder)
        attempt, last, out, n = TaskContext.get().taskAttemptId(), None, None, 0

        def close():
            if out:
                out.close()
                safe = re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", last)
                store.move(f"{top}/.{attempt}", f"{top}/{safe}.{extension}")

        for batch in batches:
            keys, lines = (batch.column(i).to_pylist() for i in range(2))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if keys[low] != last:
                    close()
                    last, out, n = keys[low], store.open_output_stream(f"{top}/.{attempt}"), n + 1
                    out.write(head.encode())
                out.write("".join([f"{line}\n" for line in lines[low:high]]).encode())
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)
    rows.select(name.alias("name"), "line").mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def write_nulls(nulls: DataFrame, path: str, by: str = "cls") -> None:
    """Keep null distributions as one long table, a folder for each value of by."""
    nulls.write.mode("overwrite").partitionBy(by).parquet(path)


def hash_manifest(spark: SparkSession, glob: str, locked: DataFrame, prefix_bytes: int | None = None) -> DataFrame:
    """Digest and size of each file against a locked (name, sha256, bytes): status ok, changed, missing or extra."""
    content = F.substring("content", 1, prefix_bytes) if prefix_bytes else F.col("content")
    files = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2(content, 256).alias("found_sha256"), F.col("length").alias("found_bytes"))
    same = (F.col("sha256") == F.col("found_sha256")) & (F.col("bytes") == F.col("found_bytes"))
    status = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(same, "ok").otherwise("changed")
    return locked.join(files, "name", "full").withColumn("status", status)
