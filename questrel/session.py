"""The session the engine expects: UTC, adaptive execution, shuffle partitions by the cluster's size."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "questrel", shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
