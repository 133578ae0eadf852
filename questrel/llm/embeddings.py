"""Embedding near-dedup: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, drop, saved

COSINE = 0.98
TABLES, HASHES, ROUNDS, SEED = 8, 2, 3, 2024  # a code joins HASHES cross-polytope hashes, each after ROUNDS rotations
BLOCK = 768  # rows of a bucket compared at once; larger buckets are dealt out as pairs of blocks


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotations: random signs, then a fast Hadamard transform; once for each row of signs."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
            h *= 2
    return x


def codes(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each vector and table its code, and its probe: the code with the least certain hash at its second choice."""
    n, d = vectors.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, wide))
    x[:, :d] = vectors
    own, probe = np.zeros((n, TABLES), np.int64), np.zeros((n, TABLES), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best, second, gap = [], [], []
        for k in range(HASHES):
            y = rotate(x, np.random.default_rng([seed, t, k, wide]).choice([-1.0, 1.0], (ROUNDS, wide)))
            size = np.abs(y)
            first = size.argmax(1)
            top = size[rows, first].copy()
            size[rows, first] = -1
            then = size.argmax(1)
            best.append(2 * first + (y[rows, first] < 0))
            second.append(2 * then + (y[rows, then] < 0))
            gap.append((top - size[rows, then]) / np.maximum(top, 1e-300))
        weak = np.argmin(gap, 0)
        for k in range(HASHES):
            own[:, t] = own[:, t] * 2 * wide + best[k]
            probe[:, t] = probe[:, t] * 2 * wide + np.where(weak == k, second[k], best[k])
    return own, probe


def _matrix(column, kind) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _hash(batches):
    for b in batches:
        if not b.num_rows:
            continue
        dims = b.column("dim").to_numpy()
        own, probe = np.zeros((len(dims), TABLES), np.int64), np.zeros((len(dims), TABLES), np.int64)
        values = b.column("v").to_pylist()
        vectors = [None] * len(values)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = np.array([values[i] for i in at], np.float64)
            x /= np.abs(x).max(1, keepdims=True)  # keeps squares in range
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            own[at], probe[at] = codes(x)
            for i, row in zip(at, x, strict=True):
                vectors[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), b.column("dim"), b.column("copies"), pa.array(vectors, pa.binary()), pa.array([r.tobytes() for r in own], pa.binary()), pa.array([r.tobytes() for r in probe], pa.binary()), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(probe), pa.list_(pa.int64()))], ["rep", "label", "dim", "copies", "unit", "own", "probe", "owns", "probes"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _block(t: int, code: int, cross: bool, part: np.ndarray, rep, copies, unit, own, probe, least: float):
    """Rows (rep, links, root) of one block or pair of blocks: links count each pair in one bucket only."""
    order = np.argsort(rep, kind="stable")
    part, rep, copies, unit, own, probe = (x[order] for x in (part, rep, copies, unit, own, probe))
    n = len(rep)
    pairs = []
    for lo in range(0, n, 256):
        near = unit[lo : lo + 256] @ unit.T >= least
        a, b = np.nonzero(near)
        a = a + lo
        ok = (a < b) & ((own[a, t] == code) | (own[b, t] == code))
        if cross:
            ok &= part[a] != part[b]
        pairs.append((a[ok], b[ok]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not len(a):
        return None
    root = _roots(n, a, b)
    new = np.ones(len(a), bool)  # not found by an earlier table
    for s in range(t):
        new &= (own[a, s] != own[b, s]) & (own[a, s] != probe[b, s]) & (probe[a, s] != own[b, s])
    both = (own[a, t] != own[b, t]) & (own[a, t] == probe[b, t]) & (probe[a, t] == own[b, t])
    new &= ~both | (np.minimum(own[a, t], own[b, t]) == code)
    a, b = a[new], b[new]
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    out = np.flatnonzero((links > 0) | (root != np.arange(n)))
    return rep[out], links[out].astype(np.int64), rep[root[out]]


def _verify(least: float, batches):
    held, key = None, None

    def done():
        if held is None or len(held[1]) < 2:
            return None
        return _block(key[2], key[3], key[4] != key[5], *held, least)

    def grown(old, new):
        return new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))

    out: list = []

    def flush():
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rep", "links", "root"])

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("label", "dim", "t", "code", "x", "y")], 1).astype(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        part, rep, copies = (b.column(c).to_numpy() for c in ("part", "rep", "copies"))
        own, probe, units = _matrix(b.column("own"), np.int64), _matrix(b.column("probe"), np.int64), b.column("unit").to_pylist()
        for lo, hi in zip(cuts, cuts[1:]):
            rows = (part[lo:hi], rep[lo:hi], copies[lo:hi], np.frombuffer(b"".join(units[lo:hi])).reshape(hi - lo, -1), own[lo:hi], probe[lo:hi])
            this = tuple(int(k) for k in keys[lo])
            if this != key:
                if (r := done()) is not None:
                    out.append(r)
                held, key = None, this
            held = grown(held, rows)
        if sum(len(x[0]) for x in out) > 10_000:
            yield flush()
    if (r := done()) is not None:
        out.append(r)
    if out:
        yield flush()


def link(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vectors: vec_id (integer), embedding (array of numbers), label (integer); other columns are ignored.

    A row for each row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable), kept. Rows are linked if their labels are equal and not null and the cosine in double
    precision is `least` or more. Vectors that are null, empty, zero or hold null or non-finite numbers,
    and rows without vec_id or label, link with nothing (n_links 0, component_id vec_id). vec_id is taken
    as a key: of rows that repeat it each counts, and they share a component. Lengths differ: no link.

    Equal vectors become one by an aggregate, so a vector with a third of all rows is one row here. Each
    distinct vector is stored in a bucket of each table and probes another; the pairs of a bucket are
    verified by matrix products in blocks, buckets over BLOCK rows as pairs of blocks over many tasks.
    Links are counted where they are found, each in the first bucket that holds the pair; what leaves a
    block is a count and a link to the smallest of its component for each vector, never all pairs. Of the tables
    on the way only the numbers for each different vector, without the vectors, outlast the call.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    v = F.col("embedding").cast("array<double>")
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(good, F.lit(False)).alias("good"), F.col("label").cast("long").alias("label"), v.alias("embedding"))
    key = [F.xxhash64("label", "embedding", F.lit(1)).alias("k0"), F.xxhash64("label", "embedding", F.lit(2)).alias("k1")]
    reps = d.where("good").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("v"))
    reps = saved(reps, "reps")
    hashed = reps.select("rep", "label", F.size("v").cast("long").alias("dim"), "copies", "v").mapInArrow(_hash, "rep long, label long, dim long, copies long, unit binary, own binary, probe binary, owns array<long>, probes array<long>")
    hashed = saved(hashed, "hashed")
    slots = F.concat(*[F.transform(c, lambda x, t: F.struct(t.cast("int").alias("t"), x.alias("code"))) for c in ("owns", "probes")])
    bucket = ["label", "dim", "t", "code"]
    sizes = hashed.select("label", "dim", F.explode(slots).alias("s")).select("label", "dim", "s.*").groupBy(*bucket).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    rows = hashed.select("rep", "label", "dim", "copies", "unit", "own", "probe", F.explode(slots).alias("s")).select("*", "s.*").drop("s")
    rows = rows.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("x"), F.greatest(o, F.col("part")).alias("y")))
    rows = rows.withColumn("p", F.explode(pairs)).select(*bucket, "p.*", "part", "rep", "copies", "unit", "own", "probe")
    place = [*bucket, "x", "y"]
    found = rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(partial(_verify, least), "rep long, links long, root long")
    found = saved(found, "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    info = reps.drop("v", "label").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    info = info.select("k0", "k1", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    info = saved(info, "linked")
    drop(reps, hashed, found)
    out = d.select("vec_id", "good", *key).join(info.withColumn("good", F.lit(True)), ["good", "k0", "k1"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_cross_polytope(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
