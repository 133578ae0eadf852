"""Names of topics, tables and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("tasks", "discovered", "results")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_name(collection: Column | str, kind: Column | str) -> Column:
    """collection.kind; a kind that is a plain string is a literal."""
    return F.concat(col(collection), F.lit("."), F.lit(kind) if isinstance(kind, str) else kind)


def collection_of_topic(topic: Column | str) -> Column:
    """What precedes the last dot; empty without a dot."""
    return F.regexp_extract(col(topic), r"(?s)^(.*)\.[^.]*$", 1)


def table_name(collection: Column | str) -> Column:
    """The first dot becomes an underscore, then _items follows."""
    return F.concat(F.regexp_replace(col(collection), r"^([^.]*)\.", "$1_"), F.lit("_items"))


def bearer_token(header: Column | str) -> Column:
    return F.regexp_replace(col(header), "^Bearer ", "")


def queue_entry_offset(entry: Column | str) -> Column:
    """The number before the first dash of an entry id such as 132-1."""
    return F.try_to_number(F.get(F.split(col(entry), "-", 2), F.lit(0)), F.lit("9" * 19)).cast("long")


def big_endian(n: Column | str) -> Column:
    """A long as 8 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(col(n)), 16, "0"))


def from_big_endian(b: Column | str) -> Column:
    """The long in 8 bytes, most significant first."""
    return F.conv(F.hex(col(b)), 16, -10).cast("long")


def session_key(worker: Column | str, session: Column | str) -> Column:
    """16 bytes: worker, then session."""
    return F.concat(big_endian(worker), big_endian(session))


def shard_key(topic: Column | str, partition: Column | str, tag: int, prefix: bytes = b"") -> Column:
    """prefix, topic, a zero byte, the partition in 4 bytes, a byte that tells the structure."""
    head = F.concat(F.lit(prefix), col(topic).cast("binary"), F.lit(b"\0"))
    return F.concat(head, F.unhex(F.lpad(F.hex(col(partition).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit(bytes([tag])))


def base64_std(data: Column | str) -> Column:
    """Base64 without padding."""
    return F.rtrim(F.base64(col(data)), F.lit("="))


def base64_url(data: Column | str) -> Column:
    return F.translate(base64_std(data), "+/", "-_")


def from_base64_url(text: Column | str) -> Column:
    """The bytes, or null for what isn't unpadded URL-safe Base64."""
    t = col(text)
    ok = t.rlike(r"\A[A-Za-z0-9_-]*\z") & (F.length(t) % 4 != 1)
    return F.when(ok, F.unbase64(F.rpad(F.translate(t, "-_", "+/"), F.ceil(F.length(t) / 4) * 4, F.lit("="))))


def status_name(status: Column | str) -> Column:
    s = col(status)
    return F.when(s == 0, "SUCCESS").when(s == 1, "CLIENT_FAILURE").when(s == 2, "TIMEOUT")


def fields_to_map(flat: Column | str) -> Column:
    """A list of alternating names and values as a map; a later name wins."""
    a = col(flat)
    at = F.sequence(F.lit(0), F.size(a) - 2, F.lit(2))
    pairs = F.transform(at, lambda i: F.struct(F.get(a, i).alias("k"), F.get(a, i + 1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(a) >= 2, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))
