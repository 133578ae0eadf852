"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, saved

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
FEWEST, WORDS, LONG = 2, 24, 40  # sentences and words in a span at least; a sentence of LONG words is a span
NONE = (1 << 63) - 1


def spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The sentences (together the text) and, as (first, count), every span.

    Spans are the shortest runs of at least FEWEST sentences with words and WORDS words, both from each such
    sentence on and back from each, so that together they cover every run of that size; a sentence of LONG
    words is a span by itself as well.
    """
    parts = SENTENCE.findall(text)
    words = [len(p.split()) for p in parts]
    full = [i for i, n in enumerate(words) if n]
    upto = [0, *accumulate(words[i] for i in full)]
    found = {(i, 1) for i in full if words[i] >= LONG}
    end = start = 0
    for k in range(len(full)):
        end = max(end, k + FEWEST)
        while end <= len(full) and upto[end] - upto[k] < WORDS:
            end += 1
        if end > len(full):
            break
        found.add((full[k], full[end - 1] - full[k] + 1))
    for k in range(FEWEST, len(full) + 1):
        while start < k - FEWEST and upto[k] - upto[start + 1] >= WORDS:
            start += 1
        if upto[k] - upto[start] >= WORDS:
            found.add((full[start], full[k - 1] - full[start] + 1))
    return parts, sorted(found)


def _hashes(parts: list[str], found: list[tuple[int, int]]) -> np.ndarray:
    clean = [" ".join(p.split()).encode("utf-8", "surrogatepass") for p in parts]
    data = b"".join(hashlib.blake2b(b" ".join(c for c in clean[i : i + n] if c), digest_size=16).digest() for i, n in found)
    return np.frombuffer(data, np.int64).reshape(-1, 2)


def _emit(batches):
    for b in batches:
        keys, rows, at, counts = [], [], [], []
        for did, th, text in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
            parts, found = spans(text)
            if found:
                rows.append(_hashes(parts, found))
                keys.append(np.broadcast_to(np.array([did, th], np.int64), (len(found), 2)))
                at += [i for i, _ in found]
                counts += [n for _, n in found]
        if rows:
            h, k = np.concatenate(rows), np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0].copy(), h[:, 1].copy(), k[:, 0].copy(), k[:, 1].copy(), np.array(at, np.int32), np.array(counts, np.int32))], ["h0", "h1", "did", "th", "at", "n"])


def _cut(batches):
    for b in batches:
        texts, sizes, gone = [], [], []
        for text, hit in zip(b.column("text").to_pylist(), b.column("hit").to_pylist(), strict=True):
            parts = SENTENCE.findall(text or "")
            drop = {j for x in hit or () for j in range(x["at"], x["at"] + x["n"])}
            sizes.append(len(parts))
            gone.append(len(drop))
            texts.append("".join(p for j, p in enumerate(parts) if j not in drop) if drop else text)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "_sentences", "_removed"])


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) without the sentences covered by a repeated span that isn't its first.

    The first of equal spans is the one of the least doc_id (null last) and position, so a span that a
    document repeats stays once in it. Spans are equal if their words are, whatever the space between.
    Rows that repeat both doc_id and text are alike and get the same cuts. Null and empty texts stay as
    they are; a text may become empty, its row stays. Adds _sentences and _removed (long); columns of
    these names are replaced.

    Spans travel as 128-bit hashes. Firsts are found by an aggregate, which combines before the shuffle;
    a span with a third of all rows meets its one first in a join that splits it.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("_sentences", "_removed")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("did"), F.xxhash64("text").alias("th")]
    rows = saved(docs.where("text is not null").select(*key, "text").mapInArrow(_emit, "h0 long, h1 long, did long, th long, at int, n int"), "spans")
    place = F.struct("did", "at", "th")
    first = rows.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h0", "h1", "first")
    first = saved(first, "firsts")  # else the join would take the aggregate's partitions, which can't be split
    hits = rows.join(first, ["h0", "h1"]).where(place != F.col("first"))
    hits = hits.groupBy("did", "th").agg(F.collect_set(F.struct("at", "n")).alias("hit"))
    rest = [c for c in docs.columns if c != "text"]
    d = docs.select(*key, F.struct(*rest).alias("row"), "text").join(hits, ["did", "th"], "left").select("row", "text", "hit")
    schema = StructType([d.schema["row"]]).add("text", "string").add("_sentences", "long").add("_removed", "long")
    return d.mapInArrow(_cut, schema).select("row.*", "text", "_sentences", "_removed").select(*docs.columns, "_sentences", "_removed")


def op10_sentence_spans(spark, sf_dir: str) -> DataFrame:
    d = dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", F.col("_sentences").alias("n_sentences"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"), "text")
