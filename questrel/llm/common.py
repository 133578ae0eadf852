"""What the corpus operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="questrel-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one of our own only where none is
    configured and all executors are in this process, as in tests. Elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Marks a folder that has been written: it goes when the application ends, if it isn't dropped before."""
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by saved() that nothing will read any more."""
    for t in tables:
        fs, p = _hadoop(t.sparkSession, t._saved_at)
        fs.delete(p, True)


SALTS = 16


def _salted_join(edges: DataFrame, of: DataFrame, key: str, other: str) -> DataFrame:
    salted = of.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [key, "salt"]).drop("salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps; each step is an aggregate and a join on salted
    keys, so a node with a third of all edges is dealt out over SALTS tasks. Each round is written to the shared
    folder. An empty table of edges gives an empty result; nulls and loops are ignored.
    """
    spark = edges.sparkSession
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        # large star: each larger neighbour of a node links to the node's smallest neighbour or itself
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _salted_join(both, least, "a", "b").where("b > a and b != m").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = _salted_join(large, least, "b", "a").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        new = saved(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("component")), F.struct(F.col("a").alias("node"), F.col("a").alias("component")))).alias("x")).select("x.*").distinct()


def release() -> None:
    """In a Python worker, which outlasts its task: gives back to the system what a large step has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LARGE = 200_000  # bytes; a longer text enters a sample after all others


def within(sizes: DataFrame, group: str, order: Column, most: int) -> DataFrame:
    """The ids (doc_id and its group) of a bounded sample, sizes: doc_id, group, n (bytes): the first of each group
    in `order`, those over LARGE last, as long as their bytes sum to `most` at most. A group of which not even the
    first fits is an error, so that none is lost unseen. Sizes are few: callers bound their rows."""
    w = Window.partitionBy(group).orderBy(F.col("n") > LARGE, order, "doc_id")
    d = sizes.withColumn("run", F.sum("n").over(w)).withColumn("place", F.row_number().over(w))
    none = F.raise_error(F.concat(F.lit(f"every sampled text with {group} "), F.col(group).cast("string"), F.lit(f" has over {most} bytes")))
    return d.where(F.when((F.col("place") == 1) & (F.col("run") > most), none.cast("boolean")).otherwise(F.col("run") <= most)).select("doc_id", group)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get batches of so many rows and 32 MB at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
