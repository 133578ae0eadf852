"""The table of a collection's items: insert what is new, add up results, count rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import table_name


def create_items(spark: SparkSession, key_type: str = "string") -> DataFrame:
    return spark.createDataFrame([], f"item_id {key_type}, found_t timestamp, last_update timestamp, updates long")


def filter_new(ids: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Distinct ids that the table lacks."""
    return ids.select(F.col(key).cast(items.schema["item_id"].dataType).alias(key)).distinct().join(items.select(F.col("item_id").alias(key)), key, "left_anti")


def insert_ignore(items: DataFrame, pointers: DataFrame, key: str = "item_id", time: str = "timestamp", arrival: str = "seq") -> DataFrame:
    """Adds pointers whose key is new, the first that arrived; found_t is its time. Known items stay."""
    return items.unionByName(new_rows(items, pointers, key, time, arrival).join(items.select("item_id"), "item_id", "left_anti"))


def new_rows(items: DataFrame, pointers: DataFrame, key: str = "item_id", time: str = "timestamp", arrival: str = "seq") -> DataFrame:
    """Pointers as rows for the items, one a key, in the types of that table, which isn't read."""
    kind = items.schema["item_id"].dataType
    first = pointers.groupBy(F.col(key).cast(kind).alias("item_id")).agg(F.min_by(time, arrival).alias("found_t"))
    return first.select("item_id", F.col("found_t").cast(items.schema["found_t"].dataType), F.lit(None).cast(items.schema["last_update"].dataType).alias("last_update"), F.lit(0).cast("long").alias("updates"))


def result_rows(results: DataFrame, key: str = "item_id", time: str = "finish_time", arrival: str = "seq", key_type: str = "string") -> DataFrame:
    """What results change in the items: the first one's time, the last one's, and how many; see merged()."""
    batch = results.groupBy(F.col(key).cast(key_type).alias("item_id")).agg(F.min_by(time, arrival).alias("found_t"), F.max_by(time, arrival).alias("last_update"), F.count("*").alias("updates"))
    return batch.select("item_id", F.col("found_t").cast("timestamp"), F.col("last_update").cast("timestamp"), "updates")


def merged(changes: DataFrame) -> DataFrame:
    """Items from their changes (and `at`, their order): the first found_t, the last last_update, all updates."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("at"))  # noqa: E731  by these, nulls count never
    d = changes.groupBy("item_id").agg(F.min_by("found_t", known("found_t")).alias("found_t"), F.max_by("last_update", known("last_update")).alias("last_update"), F.sum("updates").alias("updates"))
    return d.select("item_id", "found_t", "last_update", "updates")


def apply_results(items: DataFrame, results: DataFrame, key: str = "item_id", time: str = "finish_time", arrival: str = "seq") -> DataFrame:
    """Upsert: an unknown item starts at its first result's time with last_update the last's; each result,
    whatever its status, counts. last_update is the last by arrival, which need not be the latest."""
    kind = items.schema["item_id"].dataType
    batch = results.groupBy(F.col(key).cast(kind).alias("item_id")).agg(F.count("*").alias("n"), F.max_by(time, arrival).alias("new_t"), F.min_by(time, arrival).alias("first_t"))
    out = items.join(batch, "item_id", "full_outer")
    return out.select("item_id", F.coalesce("found_t", "first_t").alias("found_t"), F.coalesce("new_t", "last_update").alias("last_update"), (F.coalesce("updates", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("updates"))


def collection_stats(topology: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each collection's table, 0 for a missing one, in the order of the topology (position, name).

    tables: by table name. Counts are exact and read no columns.
    """
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    named = topology.withColumn("table_name", table_name("name"))
    if not counts:
        return named.select("position", "name", F.lit(0).cast("long").alias("item_count"))
    every = reduce(DataFrame.unionByName, counts)
    return named.join(every, "table_name", "left").select("position", "name", F.coalesce("n", F.lit(0)).alias("item_count")).orderBy("position")


def catalog_stats(spark: SparkSession, topology: DataFrame) -> DataFrame:
    """collection_stats over the tables of the session's current database."""
    found = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.name.endswith("_items")}
    return collection_stats(topology, found)
