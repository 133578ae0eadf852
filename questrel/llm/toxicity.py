"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, release, table, within

BUCKETS, DIM, SPAN = 1 << 17, 8, 6  # hashed n-grams, their vectors' length, words in a window
SAMPLE, SAMPLE_BYTES = 4000, 16 << 20  # labelled documents of a class, and bytes of all, that fit the model
ROUNDS, EPOCHS, RATE = 5, 20, 0.4
WORDS = re.compile(r"\w+")
CACHED = 400_000  # words whose score a worker keeps


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams of 3 to 5 bytes, with marks at both ends, and of the whole word."""
    b = b"<" + word.encode("utf-8", "replace") + b">"
    return [zlib.crc32(b) % BUCKETS, *(zlib.crc32(b[i : i + n]) % BUCKETS for n in (3, 4, 5) for i in range(len(b) - n + 1))]


class _Words:
    """Distinct words of the sample, as rows of n-gram buckets."""

    def __init__(self, texts: list[str]):
        seen: dict[str, int] = {}
        self.docs = [np.array([seen.setdefault(w, len(seen)) for w in WORDS.findall(t.lower())], np.int32) for t in texts]
        flat, sizes = array("i"), array("q")
        for w in seen:
            row = grams(w)
            flat.extend(row)
            sizes.append(len(row))
        self.sizes, self.flat = np.array(sizes, np.int64), np.array(flat, np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[words]
        at = np.repeat(self.starts[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return self.flat[at], sizes


def _sums(rows: np.ndarray, at: np.ndarray, n: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Sums of rows (or of rows[owner]) by at, a column at a time to hold little."""
    return np.stack([np.bincount(at, rows[:, j] if owner is None else rows[:, j][owner], n) for j in range(rows.shape[1])], 1)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Train on whole texts. Returns the logit that each n-gram bucket adds, and the bias.

    The logit of a run of words is the mean over its words of the mean over their n-grams. At first a
    document is one run; then each round takes the window that scores highest in each document, so the
    vectors come to tell windows apart of which only one need be toxic. With one class only, or no
    text, the logit is always -20.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), -20.0
    rng = np.random.default_rng(seed)
    words = _Words(texts)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    m = [np.full_like(x, 1e-8) for x in (emb, out, bias)]
    runs, told, hard = list(words.docs), y, []
    for r in range(ROUNDS):
        full = [i for i, d in enumerate(runs) if len(d)]
        used, at = np.unique(np.concatenate([runs[i] for i in full]), return_inverse=True)
        sizes = np.array([len(runs[i]) for i in full])
        owner = np.repeat(np.arange(len(full)), sizes)
        flat, n_grams = words.grams_of(used)
        gram, slot = np.unique(flat, return_inverse=True)
        of, first = np.repeat(np.arange(len(used)), n_grams), np.cumsum(n_grams) - n_grams
        goal = told[full]
        weight = np.where(goal > 0, 0.5 / max(1, goal.sum()), 0.5 / max(1, (1 - goal).sum()))
        for _ in range(EPOCHS):
            word = np.stack([np.add.reduceat(emb[gram, j][slot], first) for j in range(DIM)], 1) / n_grams[:, None]
            vec = _sums(word, owner, len(full), at) / sizes[:, None]
            z = vec @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - np.stack([1 - goal, goal], 1)) * weight[:, None]
            dvec = dz @ out.T
            dword = _sums(dvec / sizes[:, None], at, len(used), owner)
            dgram = _sums(dword / n_grams[:, None], slot, len(gram), of)
            for k, (x, where, grad) in enumerate(((emb, gram, dgram), (out, slice(None), vec.T @ dz + 1e-4 * out), (bias, slice(None), dz.sum(0)))):
                m[k][where] += grad * grad
                x[where] -= RATE * (4 if k == 0 else 1) * grad / np.sqrt(m[k][where])
        if r + 1 < ROUNDS:
            each = (emb @ (out[:, 1] - out[:, 0]))[words.flat]
            score = np.add.reduceat(each, words.starts) / words.sizes
            runs = []
            for d, label in zip(words.docs, y, strict=True):
                if not len(d):
                    continue
                _, k = _best(score[d])
                if label:
                    runs.append(d[k : k + SPAN])
                else:  # all windows of a clean document are clean: the worst of each round stay
                    hard.append(d[k : k + SPAN])
                    if not r:
                        hard += [d[k : k + SPAN] for k in rng.integers(0, max(1, len(d) - SPAN + 1), 3)]
            told = np.array([1.0] * len(runs) + [0.0] * len(hard))
            runs = runs + hard
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _fit_rows(batches):
    """The fit in one task: the sample is bounded, and the driver stays small."""
    texts, labels = [], []
    for b in batches:
        texts += b.column("text").to_pylist()
        labels += b.column("toxic").to_pylist()
    weights, bias = fit(texts, labels)
    texts.clear()
    release()
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def _best(scores: np.ndarray) -> tuple[float, int]:
    """The highest mean of SPAN scores in a row (all, if they are fewer), and where it starts."""
    n = min(SPAN, len(scores))
    c = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    means = (c[n:] - c[:-n]) / n
    k = int(means.argmax())
    return float(means[k]), k


def _score(model, batches):
    weights, bias = model.value
    known: dict[str, float] = {}

    def of(w: str) -> float:
        v = known[w] = float(weights[grams(w)].mean())
        return v

    for b in batches:
        scores = []
        for t in b.column("text").to_pylist():
            if len(known) > CACHED:
                known.clear()
            found = WORDS.findall((t or "").lower())
            each = np.array([v if (v := known.get(w)) is not None else of(w) for w in found])
            z = _best(each)[0] + bias if len(found) else min(bias, -20.0)
            scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        keep = [b.column(i) for i in range(b.num_columns)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(scores, pa.float64())], [*b.schema.names, "_score"])


def train(docs: DataFrame, labels: DataFrame, fold: int | None = None):
    """Fit on labelled documents (labels: doc_id, toxic), in one task, and broadcast the model, whose size is fixed.

    Fitted on at most SAMPLE documents of each class and SAMPLE_BYTES / 2 bytes of its text, by order of a hash
    of doc_id; texts over common.LARGE bytes come last. An error if not even the first text of a class fits. With a
    fold, only documents count whose crc32(doc_id as text) modulo 5 differs from it. Null labels, ids and
    texts are passed over; of a repeated id the largest label and text count.
    """
    spark = docs.sparkSession
    d = labels.where("doc_id is not null and toxic is not null")
    if fold is not None:
        d = d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != fold)
    d = d.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = [d.where(f"toxic = {c}").orderBy(order, "doc_id").limit(SAMPLE) for c in (0, 1)]
    ids = picked[0].union(picked[1])
    # bytes before texts, so that the sample is bounded
    sizes = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("n"))
    ids = within(sizes, "toxic", order, SAMPLE_BYTES // 2)
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    bounded_batches(spark)
    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fit_rows, "weights binary, bias double").first()
    model = (np.frombuffer(bytes(found.weights), np.float32), found.bias) if found else fit([], [])
    return spark.sparkContext.broadcast(model)


def score(docs: DataFrame, model) -> DataFrame:
    """docs with column _score (0 to 1, higher: toxic likelier), from whole texts only.

    A document scores as its most toxic window. Null and empty texts, and texts without words, score
    near 0. Other columns stay, but for a _score; equal texts score alike; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    d = docs.drop("_score")
    return d.mapInArrow(partial(_score, model), StructType(list(d.schema.fields)).add("_score", "double"))


def op7_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), fold=0)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    d = score(docs, model)
    return d.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
