"""Results of assignments: acknowledged, expired and dead-lettered rows of workers' queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import collection_of_topic, topic_name
from ..model import TIMEOUT

COLUMNS = ["worker", "offset", "item", "status", "exp_time"]


def ack(queue: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports (worker, offset, status, seq) meet the queue. Returns (queue, results, acknowledged).

    Of reports that repeat a row the first counts; reports of rows not queued are passed over.
    acknowledged counts the rows each worker removed.
    """
    first = reports.groupBy("worker", "offset").agg(F.min_by("status", "seq").alias("status"))
    results = queue.join(first, ["worker", "offset"]).select(*COLUMNS)
    return queue.join(first, ["worker", "offset"], "left_anti"), results, results.groupBy("worker").agg(F.count("*").alias("acknowledged"))


def expire_tasks(queue: DataFrame, now: int | Column) -> tuple[DataFrame, DataFrame]:
    """(live, results): rows from a worker's head with exp_time before now end with status 2.

    A worker's rows are seen in order of offset, up to the first that is still alive; so a later row with an
    earlier exp_time waits for it, as in a queue.
    """
    alive = queue.where(F.col("exp_time") >= now).groupBy("worker").agg(F.min("offset").alias("head"))
    d = queue.join(alive, "worker", "left")
    over = F.col("head").isNull() | (F.col("offset") < F.col("head"))
    return d.where(~over).select(*queue.columns), d.where(over).withColumn("status", F.lit(TIMEOUT)).select(*COLUMNS)


def union_results(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def forward(results: DataFrame, topic: str, finish_time: Column) -> DataFrame:
    """Results as they leave: locator, finish_time, worker_id, status; offsets stay behind."""
    locator = F.struct(collection_of_topic(F.lit(topic)).alias("collection"), F.col("item").alias("id"))
    return results.select(locator.alias("locator"), finish_time.alias("finish_time"), F.col("worker").alias("worker_id"), "status")


def checked_pointers(pointers: DataFrame) -> DataFrame:
    """pointers; reading them raises an error at one without collection, id or timestamp."""
    ok = (F.coalesce(F.col("dst.collection"), F.lit("")) != "") & (F.coalesce(F.col("dst.id"), F.lit("")) != "") & F.col("timestamp").isNotNull()
    return pointers.withColumn("dst", F.when(ok, F.col("dst")).otherwise(F.raise_error(F.concat(F.lit("bad pointer: "), F.coalesce(F.to_json("dst"), F.lit("null"))))))


def route_discovered(pointers: DataFrame) -> DataFrame:
    """Checked pointers, each with the topic of its own collection; no key."""
    d = checked_pointers(pointers)
    return d.select(topic_name(F.col("dst.collection"), "discovered").alias("topic"), F.lit(None).cast("binary").alias("key"), *pointers.columns)


def task_messages(pointers: DataFrame, collection: str) -> DataFrame:
    """New pointers as messages of the collection's tasks topic, keyed by id; the value is the destination."""
    return pointers.select(topic_name(F.lit(collection), "tasks").alias("topic"), F.col("dst.id").cast("binary").alias("key"), F.to_json("dst").cast("binary").alias("value"))
