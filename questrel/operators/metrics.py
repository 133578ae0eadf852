"""Counters of each shard (collection, partition), from logs of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = ["collection", "partition"]


def discovery_metrics(batches: DataFrame) -> DataFrame:
    """batches: collection, partition, items, new_items, a row a batch."""
    return batches.groupBy(*SHARD).agg(F.count("*").alias("batches"), F.sum("items").alias("items"), F.sum("new_items").alias("new_items"))


def assigner_metrics(batches: DataFrame) -> DataFrame:
    """batches: collection, partition, assigns, progress (null: none), and the offset after it."""
    return batches.groupBy(*SHARD).agg(
        F.count("*").alias("batches"),
        F.count_if(F.col("assigns") > 0).alias("progress_batches"),
        F.sum("assigns").alias("assigns"),
        F.max("progress").alias("offset"),
    )


def forward_metrics(batches: DataFrame) -> DataFrame:
    return batches.groupBy(*SHARD).agg(F.count("*").alias("forward_batches"), F.sum("results").alias("forward_results"))


def observed(df: DataFrame, name: str) -> DataFrame:
    """df that reports rows and, if it has them, the largest offset as it is read; see DataFrame.observe."""
    more = [F.max("offset").alias("offset")] if "offset" in df.columns else []
    return df.observe(name, F.count("*").alias("rows"), *more)


def exposition(metrics: DataFrame, prefix: str = "questrel") -> DataFrame:
    """Counters as lines of the text format that metric scrapers read; one row (line) a counter and shard."""
    names = [c for c in metrics.columns if c not in SHARD]
    label = F.format_string('{collection="%s",partition="%d"}', F.col("collection"), F.col("partition"))
    lines = [F.concat(F.lit(f"{prefix}_{c}"), label, F.lit(" "), F.coalesce(F.col(c), F.lit(0)).cast("string")) for c in names]
    return metrics.select(F.explode(F.array(*lines)).alias("line"))
