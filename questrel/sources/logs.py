"""Logs of messages as files, synthetic messages, and the decoding of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.naming import topic_name
from ..model import MESSAGE, POINTER

#: Reader options that start at the oldest message and leave commits to the checkpoint.
EARLIEST = {"startingOffsets": "earliest", "enable.auto.commit": "false", "failOnDataLoss": "true"}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).parquet(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The log as a stream, oldest files first."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_kafka(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 256) -> DataFrame:
    """The same from a broker; needs Spark's connector on the class path."""
    return spark.readStream.format("kafka").options(**EARLIEST).option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("maxOffsetsPerTrigger", per_trigger).load()


def topics_of(topology: DataFrame, kind: str) -> DataFrame:
    return topology.select(topic_name("name", kind).alias("topic"))


def append_log(messages: DataFrame, path: str) -> None:
    """Appends messages, in one folder a topic so that a reader of one topic opens its files only."""
    messages.write.mode("append").partitionBy("topic").parquet(path)


def decode(log: DataFrame, schema: str | StructType, strict: bool = True) -> DataFrame:
    """log with its JSON values as columns; a malformed value fails the read, or with strict off gives nulls."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return log.withColumn("_v", F.from_json(F.col("value").cast("string"), schema, {"mode": mode})).select(*[c for c in log.columns if c not in ("value", "timestamp")], "_v.*")


def decode_pointers(log: DataFrame, strict: bool = True) -> DataFrame:
    return decode(log, POINTER, strict)


def generate(spark: SparkSession, topic: str, n: int, first: int = 0, partition: int = 0, prefix: str = "item_") -> DataFrame:
    """n messages with consecutive offsets and keys prefix0, prefix1, ...; timestamps a second apart."""
    d = spark.range(n)
    key = F.concat(F.lit(prefix), F.col("id").cast("string"))
    value = F.to_json(F.struct(F.lit(topic.rpartition(".")[0]).alias("collection"), key.alias("id")))
    return d.select(F.lit(topic).alias("topic"), F.lit(partition).alias("partition"), (F.col("id") + first).alias("offset"), key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.timestamp_seconds(F.col("id")).alias("timestamp"))
