"""Dumps of a shard's state and of its log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = ("session_serial", "session_count", "session_expires", "worker_quota", "session_quota", "offset", "task_assigns", "active_workers", "worker_offsets", "results")


def dump_state(**sections: DataFrame) -> DataFrame:
    """Long form (section, key, value) of a state's tables: the first column is the key, the rest the value as JSON."""
    if odd := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(odd)}")
    parts = []
    for name in SECTIONS:
        if name in sections:
            d = sections[name]
            parts.append(d.select(F.lit(name).alias("section"), F.col(d.columns[0]).cast("string").alias("key"), F.to_json(F.struct(*d.columns[1:])).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def dump_log(log: DataFrame) -> DataFrame:
    """Each message as a line of JSON with offset and key, from the oldest."""
    return log.orderBy("offset").select(F.to_json(F.struct("offset", F.col("key").cast("string").alias("key"))).alias("line"))
