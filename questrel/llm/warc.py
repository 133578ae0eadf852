"""Converts legacy ARC archives to WARC, writes WARC files and reads them back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, passing, saved

# The fields of an ARC record's header line by version of the format, and WARC's marks.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC, MARK = b"WARC/1.1\r\n", b"WARC/1."
END = "\r\n\r\n"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_arc(records: list[tuple[str, bytes]], version: str = "1", date: str = "20080430204825", name: str = "legacy.arc") -> bytes:
    """An uncompressed ARC file of (url, network document) records; the version block comes first."""
    about = f"{version} 0 questrel\n{ARC_NAMES[version]}\n".encode()
    out = bytearray()
    for url, kind, block in [(f"filedesc://{name}", "text/plain", about), *((u, "text/html", b) for u, b in records)]:
        url = re.sub(r"\s", "%20", url) or "-"
        more = ["200", hashlib.md5(block).hexdigest(), "-", str(len(out)), name] if version == "2" else []
        out += " ".join([url, "0.0.0.0", date, kind, *more, str(len(block))]).encode() + b"\n" + block + b"\n"
    return bytes(out)


def read_arc(source: bytes | BinaryIO) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) for each record of an ARC file, read as a stream. The version block names the fields.

    Lengths are as declared, so blocks may hold anything; a file that ends early or a header line with
    another number of fields raises ValueError. The version block itself is not returned.
    """
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    fields = None
    while line := f.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        first = fields is None
        if first and not parts[0].startswith("filedesc:"):
            raise ValueError("an ARC file begins with its version block")
        if not first and len(parts) != len(fields):
            raise ValueError(f"{len(fields)} fields are declared, a header line has {len(parts)}")
        size = int(parts[-1])
        block = f.read(size)
        if not line.endswith(b"\n") or len(block) < size:
            raise ValueError("an ARC record is cut short")
        if first:
            fields = ARC_FIELDS[block.split(b" ", 1)[0].decode()]
        else:
            yield dict(zip(fields, parts, strict=True)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head with its empty line, and the payload; a block without a head is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def convert(fields: dict, block: bytes, refers: tuple[str, str] | None = None, number: str = "") -> bytes:
    """One ARC record as a WARC record without the closing empty lines; its id is made from number too.

    A network document with an HTTP head becomes a response, another one a resource. With refers, the
    record id and URI of a record of equal payload, it becomes a revisit that keeps the head only.
    """
    head, payload = split_http(block)
    d = fields["date"].ljust(14, "0")
    told = digest(payload)
    body, kind = (head, "revisit") if refers else (block, "response" if head else "resource")
    lines = [
        ("WARC-Type", kind),
        ("WARC-Target-URI", fields["url"]),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Record-ID", f"<urn:uuid:{record_uuid(fields['url'], told, number)}>"),
        ("WARC-IP-Address", fields["ip"]),
        ("WARC-Payload-Digest", f"sha1:{told}"),
        ("WARC-Block-Digest", f"sha1:{digest(body)}"),
        *([("WARC-Profile", SAME), ("WARC-Refers-To", refers[0]), ("X-Refers-To-Row", refers[1])] if refers else []),
        ("Content-Type", "application/http; msgtype=response" if head else fields["type"]),
        ("Content-Length", str(len(body))),
    ]
    return WARC + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + body


def record_uuid(url: str, told: str, number: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {told} {number}")


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers in lower case, block) for each record; pieces: what stands between the marks WARC/1., in order, so
    that each record begins with the rest of its version, 0 or 1.

    A block that holds a mark comes in several pieces, which the declared length puts together.
    """
    held = b""
    for piece in pieces:
        if held:
            held += MARK + piece
        elif piece:
            held = piece
        else:
            continue
        head, mark, rest = held.partition(b"\r\n\r\n")
        named = dict(line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line) if mark else {}
        named = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, v in named.items()}
        if not mark or "content-length" not in named or len(rest) < (size := int(named["content-length"])):
            continue
        yield named, rest[:size]
        held = b""
    if held:
        raise ValueError("a WARC record is cut short")


def _head(row, size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n{'' if row is None else f'X-Row: {row}\r\n'}\r\n".encode()


def _to_warc(batches):
    """(row, url, payload, number, first): each batch becomes an ARC file, version 1 or 2 in turn, and its records WARC records."""
    for i, b in enumerate(batches):
        rows = b.to_pylist()
        blocks = [(r["url"] or "-", _head(r["row"], len(r["payload"])) + r["payload"]) for r in rows]
        out = []
        for r, (fields, block) in zip(rows, read_arc(make_arc(blocks, "12"[i % 2])), strict=True):
            refers = None
            if not r["first"]:
                url = re.sub(r"\s", "%20", r["refers_url"] or "-")
                refers = f"<urn:uuid:{record_uuid(url, digest(r['payload']), str(r['refers_number']))}>", str(r["refers"])
            out.append(convert(fields, block, refers, str(r["number"])))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0, per_file: int = 20_000) -> None:
    """A WARC record for each row of pages, by way of ARC, in gzipped files of up to per_file records.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is a response (so
    is a row that repeats it), the others revisit it; a null id is smaller than any. A null body is an
    empty payload, a null URL "-". Other columns are ignored; an empty table gives no records. Record ids
    differ, for repeated rows too. What the join adds is a table of the digests that repeat: Spark broadcasts
    it if it is small, and else joins so that a hot payload splits. The files are written by Spark's text writer with WARC's end of record as line separator.
    """
    bounded_batches(pages.sparkSession, 500)
    d = pages.select(F.col(id_col).alias("row"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"))
    # a row's number is its place in the input, the same in both uses below
    d = d.withColumn("sha", F.sha1("payload")).withColumn("number", F.monotonically_increasing_id())
    latest = F.max_by(F.struct("row", "url", "number"), F.struct("row", "number")).alias("x")
    best = d.groupBy("sha").agg(latest, F.count("*").alias("n")).where("n > 1")
    best = saved(best.select("sha", F.col("x.row").alias("refers"), F.col("x.url").alias("refers_url"), F.col("x.number").alias("refers_number"), F.lit(True).alias("many")), "payloads")
    single = F.col("many").isNull() | (F.octet_length("payload") < least) | F.col("row").eqNullSafe(F.col("refers"))
    d = d.join(best, "sha", "left").select("row", "url", "number", "payload", "refers", "refers_url", "refers_number", single.alias("first"))
    d = d.coalesce(8 * pages.sparkSession.sparkContext.defaultParallelism)  # a file each, at least
    _write(d.mapInArrow(_to_warc, "value binary"), path, per_file)


def _write(records: DataFrame, path: str, per_file: int) -> None:
    records.select(F.col("value").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def _from_arc(batches):
    for b in batches:
        for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
            out, size = [], 0
            for i, (fields, block) in enumerate(read_arc(f)):
                out.append(convert(fields, block, number=f"{name}:{i}"))
                size += len(block)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def convert_arc(spark: SparkSession, source: str, path: str, per_file: int = 20_000) -> None:
    """ARC files under source (.arc or, gzipped, .arc.gz) as WARC files under path, a record for each record.

    A file is read by one task, unpacked as a stream; its packed bytes are held, which the format's custom of
    100 MB a file bounds. A broken file is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "content")
    _write(files.mapInArrow(_from_arc, "value binary"), path, per_file)


def _from_warc(batches):
    def pieces():
        for b in batches:
            yield from (x.as_py() for x in b.column(0))

    def batch(rows):
        names = ("row", "uri", "date", "record_type", "payload_bytes", "payload_digest", "refers", "payload")
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows, size = [], 0
    for h, block in parse_warc(pieces()):
        head, payload = split_http(block)
        told = dict(x.lower().split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ": " in x)
        revisit = h.get("warc-type") == "revisit"
        found, whole = (h.get(f"warc-{x}-digest", "") for x in ("payload", "block"))
        if whole.startswith("sha1:") and digest(block) != whole[5:] or found.startswith("sha1:") and not revisit and "transfer-encoding" not in told and digest(payload) != found[5:]:
            raise ValueError(f"a record's bytes differ from its digest: {h.get('warc-record-id')}")
        n = int(told["content-length"]) if revisit and told.get("content-length", "").isdigit() else None if revisit else len(payload)
        found = found.removeprefix("sha1:") or (None if revisit else digest(payload))
        rows.append((told.get("x-row"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-type"), n, found, h.get("x-refers-to-row"), None if revisit else payload))
        size += len(payload)
        if len(rows) >= 1000 or size > 16 << 20:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path: row, uri, date, record_type, payload_bytes, payload_digest, refers, payload.

    A file of version 1.0 or 1.1, gzipped or not, is read by one task as a stream of records. Each SHA-1 digest is
    verified, of payloads unless they are transfer-encoded; a missing one is made. Records of any type come back,
    those without an HTTP head with their whole block as payload; a revisit's length is null if it isn't told.
    """
    bounded_batches(spark)
    lines = spark.read.schema("value string").option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(_from_warc, "row string, uri string, date string, record_type string, payload_bytes long, payload_digest string, refers string, payload binary")


def op4_warc_from_arc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    passing(spark, path)
    d = read_warc(spark, path)
    return d.select(F.col("row").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast("long").alias("refers_to"))
