"""Quality: ordinal cumulative-link regression on graded ratings, over hashed text features."""

from __future__ import annotations

import math
import pickle
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, release, table, within

BITS = 17  # 2 ** BITS shared weights
SAMPLE, SAMPLE_BYTES = 4000, 24 << 20  # rated documents of a grade, and bytes of all, that fit the model
GRADES = 100  # different grades at most
STEPS, RATE, DECAY = 150, 0.3, 1e-5
CACHED = 400_000  # tokens whose features a worker keeps
SHAPES = ((re.compile(r"\d+"), "9"), (re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "x"), (re.compile(r"[^\W\d_]+"), "X"))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def _token(t: str) -> tuple[int, int]:
    shape = t
    for pattern, mark in SHAPES:
        shape = pattern.sub(mark, shape)
    return _slot("w " + t.lower()), _slot("s " + shape[:12])


AGAIN = _slot("again")


def features(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: words and their shapes, words said twice running, size and variety; of length 1 together."""
    tokens = text.split()
    if len(known) > CACHED:
        known.clear()
    for t in set(tokens):
        if t not in known:
            known[t] = _token(t)
    pairs = [known[t] for t in tokens]
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    flat = np.fromiter((s for p in pairs for s in p), np.int32, 2 * len(pairs))
    slots, counts = np.unique(np.concatenate([flat, np.full(again, AGAIN, np.int32)]), return_counts=True)
    values = np.log1p(counts)
    values = values / max(1e-9, math.sqrt(float(values @ values)))
    marks = [_slot("bias"), _slot(f"size {len(tokens).bit_length()}"), _slot(f"variety {round(8 * len(set(tokens)) / max(1, len(tokens)))}"), _slot(f"again {round(8 * again / max(1, len(tokens)))}")]
    return np.concatenate([slots, marks]).astype(np.int32), np.concatenate([values, np.full(len(marks), 0.3)])


def fit(texts: list[str], grades: list[int]) -> dict:
    """One weight vector for all grades, and rising thresholds: P(grade > k) = sigmoid(w.x - threshold k).

    Thresholds rise because their gaps are exponentials. Fitted by full-batch gradients with each grade of
    equal total weight. One grade only: that grade always. None: grade 0.
    """
    levels = sorted(set(grades)) or [0]
    k = len(levels)
    if k == 1:
        return {"levels": levels, "w": np.zeros(1 << BITS, np.float32), "cuts": np.zeros(0)}
    y = np.searchsorted(levels, grades)
    known: dict = {}
    rows = [features(t, known) for t in texts]
    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    used, slot = np.unique(np.concatenate([s for s, _ in rows]), return_inverse=True)
    value = np.concatenate([v for _, v in rows])
    w, gaps = np.zeros(len(used)), np.zeros(k - 1)
    gaps[0] = -0.5
    seen_w, seen_g = np.full(len(used), 1e-6), np.full(k - 1, 1e-6)
    weight = 1.0 / (k * np.bincount(y, minlength=k)[y])
    low, high = np.maximum(y - 1, 0), np.minimum(y, k - 2)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(STEPS):
        cuts = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        z = np.bincount(owner, w[slot] * value, len(rows))
        below = np.where(y > 0, sigmoid(cuts[low] - z), 0.0)  # P(grade < y)
        upto = np.where(y < k - 1, sigmoid(cuts[high] - z), 1.0)  # P(grade <= y)
        p = np.maximum(upto - below, 1e-9)
        d_upto, d_below = upto * (1 - upto) / p, below * (1 - below) / p
        dz = weight * (d_upto - d_below)
        dcut = -np.bincount(high, weight * d_upto * (y < k - 1), k - 1) + np.bincount(low, weight * d_below * (y > 0), k - 1)
        dgap = np.cumsum(dcut[::-1])[::-1] * np.concatenate([[1.0], np.exp(gaps[1:])])
        dw = np.bincount(slot, dz[owner] * value, len(used)) + DECAY * w
        seen_w += dw * dw
        seen_g += dgap * dgap
        w -= RATE * dw / np.sqrt(seen_w)
        gaps -= RATE * dgap / np.sqrt(seen_g)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return {"levels": levels, "w": full, "cuts": np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))}


def _fit_rows(batches):
    """The fit in one task: the sample is bounded, and the driver stays small."""
    texts, grades = [], []
    for b in batches:
        texts += b.column("text").to_pylist()
        grades += b.column("grade").to_pylist()
    model = pickle.dumps(fit(texts, grades))
    texts.clear()
    release()
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def _score(model, batches):
    m = model.value
    levels, w, cuts = np.array(m["levels"], float), m["w"], m["cuts"]
    known: dict = {}
    for b in batches:
        z = np.array([float(w[s] @ v) for s, v in (features(t or "", known) for t in b.column("text").to_pylist())])
        over = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -30, 30)))  # P(grade > each but the last)
        expected = levels[0] + over @ np.diff(levels)
        tail = over[:, -1] if len(cuts) else np.ones(len(z))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], [*b.schema.names, "_expected", "_tail"])


def train(docs: DataFrame, ratings: DataFrame, grade: str = "quality", fold: int | None = None):
    """Fit on rated documents (ratings: doc_id and the grade, integers) and broadcast the model.

    More than GRADES different grades are an error. Fitted on at most SAMPLE documents a grade and an equal share
    of SAMPLE_BYTES bytes of text, by order of a hash of doc_id; texts over common.LARGE bytes come last, and it is an
    error if not even the first text of a grade fits. With a fold, only on documents whose crc32(doc_id as text)
    modulo 5 differs from it. Nulls are passed over; of a repeated id the largest grade and text count.
    """
    spark = docs.sparkSession
    d = ratings.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull())
    if fold is not None:
        d = d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != fold)
    d = d.groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    order = F.xxhash64("doc_id", F.lit(13))
    levels = [r.grade for r in d.select("grade").distinct().orderBy("grade").limit(GRADES + 1).collect()]
    if len(levels) > GRADES:
        raise ValueError(f"more than {GRADES} different grades: give coarser ones")
    ids = None
    for level in levels:
        part = d.where(F.col("grade") == level).orderBy(order, "doc_id").limit(SAMPLE)
        ids = part if ids is None else ids.union(part)
    if ids is None:
        return spark.sparkContext.broadcast(fit([], []))
    sizes = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "grade").agg(F.max(F.octet_length("text")).alias("n"))
    ids = within(sizes, "grade", order, SAMPLE_BYTES // len(levels))
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "grade").agg(F.max("text").alias("text"))
    bounded_batches(spark)
    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fit_rows, "model binary").first()
    return spark.sparkContext.broadcast(pickle.loads(found.model) if found else fit([], []))


def score(docs: DataFrame, model) -> DataFrame:
    """docs with _expected (expected grade) and _tail (probability of the highest grade), from whole texts only.

    Null and empty texts count as texts without words. Other columns stay, but for ones of these two
    names; an empty table stays empty; equal texts score alike.
    """
    bounded_batches(docs.sparkSession)
    d = docs.drop("_expected", "_tail")
    return d.mapInArrow(partial(_score, model), StructType(list(d.schema.fields)).add("_expected", "double").add("_tail", "double"))


def op9_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), fold=0)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    d = score(docs, model)
    return d.select("doc_id", held.alias("held_out"), F.col("_expected").alias("expected_grade"), F.col("_tail").alias("tail_probability"), (F.col("_tail") >= 0.5).alias("keep"))
