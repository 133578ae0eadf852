"""Which of a batch's items are new: exact deduplication against a table or a set of bits."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Dedup(Protocol):
    """A set of keys that takes batches (add) and keeps from a batch what it doesn't hold (filter)."""

    def add(self, df: DataFrame, key: str) -> Dedup: ...

    def filter(self, df: DataFrame, key: str) -> DataFrame: ...


def last_by_key(df: DataFrame, keys: list[str], arrival: str | Column) -> DataFrame:
    """The row that arrived last for each key.

    A max_by aggregate, not a window: it combines before the shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), arrival).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def first_by_key(df: DataFrame, keys: list[str], arrival: str | Column) -> DataFrame:
    """The row that arrived first for each key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), arrival).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


class TableDedup:
    """Against the ids of a table, by a left anti join. add() does nothing: the table's writer adds.

    Keys are cast to the table's key type first, so that text such as '007' meets 7; what can't be cast is
    an error in filter(), as everywhere in Spark's ANSI mode.
    """

    def __init__(self, items: DataFrame, item_key: str = "item_id"):
        self.items, self.item_key = items, item_key

    def add(self, df: DataFrame, key: str) -> TableDedup:
        return self

    def filter(self, df: DataFrame, key: str, arrival: str | Column | None = None) -> DataFrame:
        """One row for each new key: the one that arrived last, or any."""
        kind = self.items.schema[self.item_key].dataType
        batch = df.withColumn(key, F.col(key).cast(kind))
        one = last_by_key(batch, [key], arrival) if arrival is not None else batch.dropDuplicates([key])
        known = self.items.select(F.col(self.item_key).alias(key)).where(F.col(key).isNotNull())
        return one.join(known, key, "left_anti")


def number_key(key: str | Column) -> Column:
    """A key as an unsigned number (decimal(20,0)); anything else raises an error that names it."""
    c = F.col(key) if isinstance(key, str) else key
    n = F.when(c.cast("string").rlike(r"\A[0-9]{1,20}\z"), c.cast("decimal(20,0)"))
    ok = n.isNotNull() & (n <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.when(ok, n).otherwise(F.raise_error(F.concat(F.lit('item is not a number: "'), F.coalesce(c.cast("string"), F.lit("null")), F.lit('"'))))


def small_key(key: str | Column) -> Column:
    """number_key() as a long, for keys below 2**63; most take the short way, the rest number_key()'s."""
    c = F.col(key) if isinstance(key, str) else key
    short = F.when(c.cast("string").rlike(r"\A[0-9]{1,18}\z"), c.cast("long"))
    return F.coalesce(short, number_key(c).cast("long"))


class BitmapDedup:
    """Against an exact set of numbers, held as bits of buckets of 2**exp.

    The state is (bucket, bits): one binary row a bucket, most significant bit first. Each step is an
    aggregate by bucket; nothing is kept on the driver. Keys must be below 2**63.
    """

    def __init__(self, state: DataFrame, exp: int = 10):
        if not 3 <= exp <= 15:
            raise ValueError("exp must be from 3 to 15")  # Spark's bitmaps hold 2**15 bits
        self.state, self.exp = state, exp

    @classmethod
    def empty(cls, spark, exp: int = 10) -> BitmapDedup:
        return cls(spark.createDataFrame([], "bucket long, bits binary"), exp)

    def place(self, n: str | Column) -> tuple[Column, Column]:
        """Bucket and bit of a number (long)."""
        n = F.col(n) if isinstance(n, str) else n
        return F.shiftright(n, self.exp), n.bitwiseAND(F.lit((1 << self.exp) - 1))

    def _reversed(self, bit: Column) -> Column:
        """Spark sets bits least significant first within a byte."""
        return F.shiftright(bit, 3) * 8 + (7 - bit.bitwiseAND(F.lit(7)))

    def _trimmed(self, bitmap: Column) -> Column:
        return F.substring(bitmap, F.lit(1), F.lit(1 << (self.exp - 3)))

    def add(self, df: DataFrame, key: str) -> BitmapDedup:
        bucket, bit = self.place("_n")
        new = df.select(small_key(key).alias("_n")).select(bucket.alias("bucket"), self._reversed(bit).alias("b")).groupBy("bucket").agg(F.bitmap_construct_agg("b").alias("bits"))
        both = self.state.select("bucket", "bits").unionByName(new.select("bucket", self._trimmed(F.col("bits")).alias("bits")))
        return BitmapDedup(both.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).select("bucket", self._trimmed(F.col("bits")).alias("bits")), self.exp)

    def filter(self, df: DataFrame, key: str) -> DataFrame:
        """One row for each number whose bit isn't set, ascending."""
        bucket, bit = self.place("_n")
        d = df.withColumn("_n", small_key(key)).dropDuplicates(["_n"]).withColumn("_bucket", bucket).withColumn("_bit", bit)
        d = d.join(self.state.withColumnRenamed("bucket", "_bucket").withColumnRenamed("bits", "_bits"), "_bucket", "left")
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, (7 - F.col("_bit").bitwiseAND(F.lit(7))).cast("int")) == 1
        return d.where(~F.coalesce(is_set, F.lit(False))).orderBy("_n").select(*df.columns)


def offset_gaps(log: DataFrame, keys: list[str], offset: str = "offset") -> DataFrame:
    """Rows whose offset doesn't exceed the one before in their shard's order of arrival (column seq)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    return log.withColumn("previous", F.lag(offset).over(w)).where(F.col(offset) <= F.col("previous"))
