"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the control characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator in the shared folder; they go when the block ends, or by drop() before.

    Everything that reads them must have been written by then: what a lazy result still reads is made by `written`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.tables])

    def written(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        got = written(df, name, codec, path)
        self.tables.append((got, path))
        return got

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables whose last reader has been written."""
        for path in [p for t, p in self.tables if any(t is x for x in tables)]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.tables = [(t, p) for t, p in self.tables if not any(t is x for x in tables)]


def let(value: Column, use) -> Column:
    """Evaluate value once per row and hand it to use(), as higher-order functions do not share subexpressions."""
    return F.transform(F.array(value), use)[0]


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes of columns, key_1 and key_2, never null: what is decided by these columns is joined back by them."""
    return [F.xxhash64(F.lit(n), *map(F.col, cols)).alias(f"key_{n}") for n in (1, 2)]


def without(docs: DataFrame, gone: DataFrame, cols: tuple[str, ...], broadcast_rows: int = 200_000) -> DataFrame:
    """docs without the rows whose row_key of cols is in gone (key_1, key_2); no column of docs is added or renamed."""
    own = docs.select(F.struct(*docs.columns).alias("own"), *row_key(*cols))
    return own.join(small_or_shuffled(gone.select("key_1", "key_2").distinct(), broadcast_rows), ["key_1", "key_2"], "left_anti").select("own.*")


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text is a multiple of 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def uniform(col: Column) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)


def small_or_shuffled(small: DataFrame, max_rows: int, known: int | None = None) -> DataFrame:
    """Broadcast a side only when it is counted and within max_rows; otherwise Spark shuffles both sides. `known` is a bound of its rows, if there is one."""
    few = known is not None and known <= max_rows
    return F.broadcast(small) if few or small.count() <= max_rows else small


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a table that has one row a key, where one key may hold a third of rows.

    Keys of more than a hundred-thousandth of all rows, of which there are 100,000 at most, are joined by
    broadcast; the others by a shuffle, in which none of them is hot.
    """
    often = max(1000, rows.count() // 100_000)
    hot = rows.groupBy(*keys).count().where(F.col("count") > often).select(*keys).join(table, keys).withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = met.where("_hot is null").select(*rows.columns).join(table, keys)
    return met.where("_hot").drop("_hot").unionByName(rest)


def _forest(batches):
    """(node, component) for all nodes of the links (u, v) of one task."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    yield pa.record_batch([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None, at_once: int = 100_000) -> DataFrame:
    """(node, component) for the nodes of undirected links; component is the smallest node reachable.

    Alternates large-star and small-star steps on tables written to the shared folder until the
    links no longer change; every step is a shuffle with map-side combine on the links alone. With a
    scratch the tables of former steps go at once. Links are counted first: up to at_once are a small partition, which a task joins into
    trees, as shuffles over all partitions would take longer than the work. The links should be a written table.
    """
    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    keep = scratch or Scratch(links.sparkSession)
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    if links.count() <= at_once:
        return keep.written(links.coalesce(1).mapInArrow(_forest, "node bigint, component bigint"), "components")
    edges = keep.written(links.distinct(), "links")
    seen, now = None, mark(edges)
    while seen != now and now[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        last, edges = edges, keep.written(small, "links")
        if scratch:
            scratch.drop(last)
        seen, now = now, mark(edges)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
