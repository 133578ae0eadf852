"""Workers' tokens: sign and check, store and revoke, look up through a cache."""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import base64_std, base64_url, bearer_token, col, from_base64_url
from ..model import TOKENS

PREFIX, TEXT_PREFIX = 11, "H"  # fixed values: the first byte of a token and the first letter of its text
ID_SIZE, TAG_SIZE, KEY_SIZE, TEXT_SIZE = 16, 16, 32, 45


def mac(secret: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=TAG_SIZE, key=secret).digest()


def new_id() -> bytes:
    return os.urandom(ID_SIZE)


def sign(id_: Column | str, secret: bytes) -> Column:
    """The tag of each id: keyed BLAKE2b of 128 bits, which Spark has no function for."""
    if len(secret) != KEY_SIZE:
        raise ValueError(f"the secret must have {KEY_SIZE} bytes")

    @F.pandas_udf("binary")
    def tag(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else mac(secret, bytes(x)))

    return tag(col(id_))


def verify(tag: Column | str, id_: Column | str, secret: bytes) -> Column:
    """Whether the tag is the id's, compared in constant time."""

    @F.pandas_udf("boolean")
    def ok(tags: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or i is None else hmac.compare_digest(bytes(t), mac(secret, bytes(i))) for t, i in zip(tags, ids, strict=True)], dtype=object)

    return ok(col(tag), col(id_))


def serialize(tag: Column | str, id_: Column | str) -> Column:
    return F.concat(F.lit(bytes([PREFIX])), col(tag), col(id_))


def marshal(token: Column | str) -> Column:
    return F.concat(F.lit(TEXT_PREFIX), base64_url(token))


def unmarshal(text: Column | str) -> Column:
    """The 33 bytes in a token's text, or null if its length, first letter, alphabet or first byte is wrong."""
    t = col(text)
    raw = F.when((F.length(t) == TEXT_SIZE) & t.startswith(TEXT_PREFIX), from_base64_url(F.substring(t, 2, TEXT_SIZE - 1)))
    return F.when((F.octet_length(raw) == 1 + TAG_SIZE + ID_SIZE) & (F.substring(raw, 1, 1) == F.lit(bytes([PREFIX]))), raw)


def tag_of(token: Column | str) -> Column:
    return F.substring(col(token), 2, TAG_SIZE)


def id_of(token: Column | str) -> Column:
    return F.substring(col(token), 2 + TAG_SIZE, ID_SIZE)


def lookup(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (column id) with worker_id, null for an unknown one, and valid."""
    found = tokens.select("id", "worker_id")
    return ids.join(found, "id", "left").withColumn("valid", F.col("worker_id").isNotNull())


def authenticate(requests: DataFrame, tokens: DataFrame, secret: bytes, header: str = "authorization") -> DataFrame:
    """requests with verdict (ok, corrupt, bad_mac, unknown, invalid) and worker_id. A stored token is invalid if the
    tokens have a column valid that isn't true for it."""
    d = requests.withColumn("_token", unmarshal(bearer_token(header)))
    d = d.withColumn("_id", id_of("_token")).withColumn("_ok", verify(tag_of("_token"), F.col("_id"), secret))
    valid = F.coalesce("valid", F.lit(False)) if "valid" in tokens.columns else F.lit(True)
    d = d.join(tokens.select(F.col("id").alias("_known"), F.col("worker_id").alias("_worker"), valid.alias("_valid")), F.col("_id") == F.col("_known"), "left")
    verdict = F.when(F.col("_token").isNull(), "corrupt").when(~F.col("_ok"), "bad_mac").when(F.col("_known").isNull(), "unknown").when(~F.col("_valid"), "invalid").otherwise("ok")
    return d.withColumn("verdict", verdict).withColumn("worker_id", F.when(F.col("verdict") == "ok", F.col("_worker"))).drop("_token", "_id", "_ok", "_known", "_worker", "_valid")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TOKENS)


def create(tokens: DataFrame, worker: int, description: str, secret: bytes, now, id_: bytes | None = None) -> tuple[DataFrame, str]:
    """(tokens with one more, its text)."""
    spark = tokens.sparkSession
    id_ = id_ or new_id()
    import base64

    text = TEXT_PREFIX + base64.urlsafe_b64encode(bytes([PREFIX]) + mac(secret, id_) + id_).decode().rstrip("=")
    row = spark.createDataFrame([(bytearray(id_), worker, now, None, text[-4:], description)], TOKENS)
    return tokens.unionByName(row), text


def listed(tokens: DataFrame, worker: int) -> DataFrame:
    """A worker's tokens: id as text, times, last four characters, description."""
    return tokens.where(F.col("worker_id") == worker).select(base64_std("id").alias("id"), "created_at", "last_used_at", "token_bit", "description")


def revoke(tokens: DataFrame, worker: int, id_: bytes) -> tuple[DataFrame, bool]:
    """(tokens without that one, whether the worker had it)."""
    hit = (F.col("worker_id") == worker) & (F.col("id") == F.lit(id_))
    return tokens.where(~F.coalesce(hit, F.lit(False))), not tokens.where(hit).isEmpty()


def revoke_all(tokens: DataFrame, worker: int) -> tuple[DataFrame, int]:
    hit = F.col("worker_id") == worker
    return tokens.where(~F.coalesce(hit, F.lit(False))), tokens.where(hit).count()


# ---- cache of look-ups


def cached(entries: DataFrame, key: str, ts: str, ttl: int, size: int, now: int) -> DataFrame:
    """What a cache of `size` entries holds: the last entry of each key that isn't older than ttl, the latest first.

    A limit over a sort, so no partition holds more than `size` rows of the result.
    """
    rest = [c for c in entries.columns if c != key]
    last = entries.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_e")).select(key, "_e.*")
    return last.where((F.lit(now) - F.col(ts)) <= ttl).orderBy(F.col(ts).desc(), F.col(key)).limit(size).select(*entries.columns)


def cached_by(entries: DataFrame, shard: str, key: str, ts: str, ttl: int, size: int, now: int) -> DataFrame:
    """The same for many caches at once, one for each value of shard."""
    rest = [c for c in entries.columns if c not in (shard, key)]
    last = entries.groupBy(shard, key).agg(F.max_by(F.struct(*rest), ts).alias("_e")).select(shard, key, "_e.*")
    rank = F.row_number().over(Window.partitionBy(shard).orderBy(F.col(ts).desc(), F.col(key)))
    return last.where((F.lit(now) - F.col(ts)) <= ttl).withColumn("_r", rank).where(F.col("_r") <= size).select(*entries.columns)


def oldest(entries: DataFrame, ts: str, n: int = 1) -> DataFrame:
    return entries.orderBy(ts).limit(n)


def apply_invalidations(cache: DataFrame, invalidations: DataFrame, key: str = "id") -> DataFrame:
    return cache.join(invalidations.select(key).distinct(), key, "left_anti")


def add_invalidation(invalidations: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """The latest `keep` invalidations (id, seq)."""
    return invalidations.unionByName(new).orderBy(F.col("seq").desc()).limit(keep)
