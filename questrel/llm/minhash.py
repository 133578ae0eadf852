"""Near-duplicate documents by Order MinHash, candidates verified by banded alignment."""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, drop, saved

SHINGLE, LIKE = 5, 0.8  # words in a run that sketches sample; share of words that align
BANDS, LEAST = 32, 2  # sketches of a text, and minima in each
BRIEF, PAIR, MORE = 60, 2, 16  # texts of so many words or fewer also get MORE sketches over runs of PAIR words
CACHED = 400_000
QUERIES, MEMBERS, WORDS = 2048, 4096, 1 << 21  # documents of a bucket that meet at once, and the members' words, about
STEPS = 4  # lengths that meet lie within one step of 1/least; bins of a bucket's lengths are so many steps wide
FOLD = 512  # cells in which words are counted before they are aligned
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


_MULT = _mix(np.arange(1, BANDS + MORE + 1, dtype=np.uint64) * _PRIME) | np.uint64(1)


def hashed(text: str | None, known: dict) -> np.ndarray:
    """A 64-bit hash of each word. Words are split at white space, in lower case."""
    words = (text or "").lower().split()
    if len(known) > CACHED:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    return np.array([known[w] for w in words], np.uint64)


def shingles(each: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words (of all, if there are fewer), and the same with their occurrence number
    in the text, so that no two are equal. There is one word at least."""
    size = min(size, len(each))
    n = len(each) - size + 1
    plain = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            plain = _mix(plain * _PRIME + each[j : j + n])
        order = np.argsort(plain, kind="stable")
        ranked = plain[order]
        starts = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
        return plain, _mix(plain + occurrence * np.uint64(0xA24BAED4963EE407))


def bands(plain: np.ndarray, labelled: np.ndarray, first: int = 0, last: int = BANDS) -> np.ndarray:
    """Order-min-hash sketches number `first` up to `last`.

    A sketch ranks the labelled shingles by one hash function, takes the LEAST lowest and joins them in
    their order in the text.
    """
    n, mult = len(labelled), _MULT[first:last]
    step = max(1, min(len(mult), (1 << 22) // n))
    places = []
    with np.errstate(over="ignore"):
        for lo in range(0, len(mult), step):
            ranks = _mix(labelled[None, :] * mult[lo : lo + step, None])
            rows = np.arange(len(ranks))
            found = []
            for _ in range(min(LEAST, n)):
                at = ranks.argmin(1)
                found.append(at)
                ranks[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
            places.append(np.sort(np.stack(found, 1), 1))
        out = np.arange(first, last, dtype=np.uint64)
        for at in np.concatenate(places).T:
            out = _mix(out * _PRIME + plain[at])
    return out


def sketches(each: np.ndarray) -> np.ndarray:
    """All sketches of a text of one word at least.

    Of 100 words that align to 0.8, as few as 4 in 9 runs of five may be whole, and fewer in a short text:
    so BANDS sketches of LEAST minima, and for brief texts MORE over shorter runs. A brief text's partner
    of 0.8 is brief itself or both are long enough for runs of five.
    """
    found = bands(*shingles(each))
    return np.concatenate([found, bands(*shingles(each, PAIR), BANDS, BANDS + MORE)]) if len(each) <= BRIEF else found


def needed(a: int, b, least: float):
    """How many words must align in texts of a and b words."""
    return least * (a + b) / (1 + least) - 1e-9


def alike(a: np.ndarray, b: np.ndarray, least: float = LIKE) -> bool:
    """Whether two texts, as hashes of their words, align well enough: with L the length of their longest common
    subsequence of words, L / (|a| + |b| - L) >= least. Exact: see aligned()."""
    need, n = needed(len(a), len(b), least), min(len(a), len(b))
    if n < need:
        return False
    same = a[:n] == b[:n]  # equal ends are aligned as they stand
    head = n if same.all() else int(same.argmin())
    a, b, n = a[head:], b[head:], n - head
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(same.argmin())
    a, b, n, need = a[: len(a) - tail], b[: len(b) - tail], n - tail, need - head - tail
    if need <= 0 or n < need:
        return need <= 0
    if np.minimum(folded(a), folded(b)).sum() < need:
        return False
    return aligned(a.tolist(), b.tolist(), need) >= need


def folded(a: np.ndarray) -> np.ndarray:
    """Words counted in FOLD cells: the cells' lesser counts sum to no less than any alignment's length."""
    return np.bincount((a & (FOLD - 1)).astype(np.int64), minlength=FOLD)


def aligned(a: list[int], b: list[int], need: float) -> int:
    """The length of the longest common subsequence if it is `need` or more, else some number below it.

    To reach it, a match may lie so far off the diagonal only as words may stay unmatched; so only that band
    is looked at. A row of the band is one integer whose zeros mark where the length rises; a word of b
    moves them by an addition (bit-parallel dynamic programming), and the band moves on by one place.
    """
    before, after = int(len(b) - need), int(len(a) - need)
    width = before + after + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[int, int] = {}
    there = set(b)
    for i, x in enumerate(a):
        if x in there:
            places[x] = places.get(x, 0) | 1 << i
    row, done = full, 0
    for j, x in enumerate(b):
        if j:
            done += not row & 1
            row = row >> 1 | top
        m = places.get(x)
        if m:
            m = m >> (j - before) if j >= before else m << (before - j)
            hit = row & m
            if hit:
                row = (row + hit | row - hit) & full
        if not j & 127 and done + width - row.bit_count() + len(b) - j - 1 < need:
            return 0
    return done + width - row.bit_count()


def _sketch(batches):
    known: dict = {}
    for b in batches:
        sizes, found = [], []
        for text in b.column("text").to_pylist():
            each = hashed(text, known)
            sizes.append(len(each))
            found.append(sketches(each).astype(np.int64).tobytes() if len(each) else None)
        yield pa.RecordBatch.from_arrays([b.column("did"), b.column("k0"), b.column("k1"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["did", "k0", "k1", "n", "sketch"])


def _unpack(batches):
    for b in batches:
        if b.num_rows:
            found = b.column("sketch").to_pylist()
            sizes = np.array([len(x) // 8 for x in found])
            band = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int64)), *(pa.array(np.repeat(b.column(c).to_numpy(), sizes)) for c in ("rep", "n"))], ["band", "h", "rep", "n"])


def _words(batches):
    known: dict = {}
    for b in batches:
        data = [hashed(t, known).astype(np.uint32).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(data, pa.binary())], ["rep", "data"])


def _verify(least, batches):
    for b in batches:
        pairs = zip(b.column("da").to_pylist(), b.column("db").to_pylist(), strict=True)
        ok = pa.array([alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])


def _meet(least, batches):
    """Blocks (sorted by place) of queries and members of one bucket. A query meets all members at once by their
    folded counts; what may align enough and isn't joined by the block's links yet is aligned. Yields the links that
    join classes, in a block fewer than it has classes."""
    held: list = []
    place = None
    out: list = []

    def done():
        queries = [r for r in held if r[0]]
        members = [r for r in held if not r[0]]
        if not queries or not members:
            return
        data = [np.frombuffer(r[3], np.uint32) for r in members]
        sizes = np.array([len(x) for x in data])
        counts = np.stack([folded(x).astype(np.int32) for x in data])
        of = np.array([r[2] for r in members])
        up = {r[2]: r[2] for r in held}

        def top(c):
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        for _, rep, own, raw in queries:
            x = np.frombuffer(raw, np.uint32)
            need = needed(len(x), sizes, least)
            may = np.flatnonzero((np.minimum(sizes, len(x)) >= need) & (of != own))
            may = may[np.minimum(counts[may], folded(x).astype(np.int32)).sum(1) >= need[may]]
            for k in may.tolist():
                p, q = top(own), top(members[k][2])
                if p != q and alike(x, data[k], least):
                    up[p] = q
                    out.append((rep, members[k][1]))

    def flush():
        rows = [(min(a, b), max(a, b)) for a, b in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    for b in batches:
        for *key, query, rep, c, data in zip(*(b.column(x).to_pylist() for x in ("band", "h", "bin", "x", "y", "query", "rep", "c", "data")), strict=True):
            if key != place:
                done()
                held, place = [], key
            held.append((query, rep, c, data))
        if out:
            yield flush()
    done()
    if out:
        yield flush()


def _keys() -> list:
    k0 = F.xxhash64("text", F.lit(1))
    did = F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(k0, 2))
    return [did.alias("did"), k0.alias("k0"), F.xxhash64("text", F.lit(2)).alias("k1")]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*_keys(), "text")


def classes(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """docs: doc_id (integer, a key), text; other columns are ignored. A row for each (doc_id, text):
    did, k0, k1 (128-bit hash of the text), rows (how often it occurs), class_id, the least id of its class.

    Documents are linked if their texts are equal or their words align to `least` or more (see alike());
    classes are what links join. Null, empty and blank texts link with nothing. A null doc_id gets a
    negative id made from its text. An empty table gives an empty result.

    Equal texts become one by an aggregate first. Then each bucket (sketch number and hash) links its members
    to its least member, so a bucket with a third of all rows makes as many candidates as it has members. What
    a bucket still holds outside its least member's class meets all of the bucket whose length allows a link, in
    blocks that compare many at once and yield links between classes only; so no candidate is lost, and no pairs
    are listed. A block's texts are bounded in number and words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    light = saved(_rows(docs).mapInArrow(_sketch, "did long, k0 long, k1 long, n long, sketch binary"), "sketches")
    reps = light.where("n > 0").groupBy("k0", "k1").agg(F.min("did").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = saved(reps, "reps")
    buckets = saved(reps.select("rep", "n", "sketch").mapInArrow(_unpack, "band int, h long, rep long, n long"), "buckets")
    center = buckets.groupBy("band", "h").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").drop("z")
    center = saved(center, "centers")  # a join of two tables can split a hot key
    shared = saved(buckets.join(center.hint("merge"), ["band", "h"]), "shared")
    drop(buckets, center)

    wanted = reps.join(shared.select("rep").distinct().hint("merge"), "rep", "left_semi").select("k0", "k1", F.col("rep").alias("did"))
    texts = _rows(docs).join(wanted.hint("merge"), ["did", "k0", "k1"]).select(F.col("did").alias("rep"), "text")
    data = saved(texts.mapInArrow(_words, "rep long, data binary").dropDuplicates(["rep"]), "words")
    left, right = (data.select(F.col("rep").alias(x), F.col("data").alias(f"d{x}")) for x in "ab")
    pairs = saved(shared.where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "da", "db")
    links = saved(links.mapInArrow(partial(_verify, least), "a long, b long"), "links")
    joined = saved(components(links), "joined")
    drop(pairs)

    place = ["band", "h"]
    size = F.log("n") / math.log(1 / least)  # texts that align differ by one at most
    bin_of = lambda x: F.floor(x / STEPS).cast("int")
    of = shared.join(joined.hint("merge"), shared.rep == joined.node, "left")
    of = saved(of.select(*place, "rep", F.coalesce("component", "rep").alias("c"), bin_of(size).alias("bin"), bin_of(size - 1.001).alias("low"), bin_of(size + 1.001).alias("high")), "classed")
    drop(shared)
    main = of.groupBy(*place).agg(F.min_by("c", "rep").alias("main"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1")
    main = saved(main.select(*place, "main"), "mains")
    mixed = saved(of.join(main.hint("merge"), place).withColumn("query", F.col("c") != F.col("main")), "mixed")
    asking = mixed.where("query").withColumn("bin", F.explode(F.sequence("low", "high")))
    xs = F.ceil(F.count("*") / QUERIES).cast("int")
    longest = F.pow(F.lit(1 / least), (F.col("bin") + 1) * STEPS)
    ys = F.ceil(F.count("*") * F.greatest(F.lit(1 / MEMBERS), F.least(longest / WORDS, F.lit(1.0)))).cast("int")
    cells = asking.groupBy(*place, "bin").agg(xs.alias("xs")).join(mixed.groupBy(*place, "bin").agg(ys.alias("ys")).hint("merge"), [*place, "bin"])
    cells = saved(cells, "cells")
    drop(of, main)
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = cells.hint("merge")
    members = mixed.join(cells, [*place, "bin"]).select(*place, "bin", every("xs").alias("x"), part("ys").alias("y"), F.lit(False).alias("query"), "rep", "c")
    queries = asking.join(cells, [*place, "bin"]).select(*place, "bin", part("xs").alias("x"), every("ys").alias("y"), F.lit(True).alias("query"), "rep", "c")
    sent = members.unionByName(queries).join(data.hint("merge"), "rep")
    sent = sent.repartition(*place, "bin", "x", "y").sortWithinPartitions(*place, "bin", "x", "y")
    more = saved(sent.mapInArrow(partial(_meet, least), "a long, b long"), "links")
    if not more.isEmpty():
        first, joined = joined, saved(components(links.union(more)), "joined")
        drop(first)
    known = reps.join(joined.hint("merge"), reps.rep == joined.node, "left").select("k0", "k1", F.coalesce("component", "rep").alias("class_id"))
    rows = light.groupBy("did", "k0", "k1", "n").agg(F.count("*").alias("rows"))
    out = rows.where("n > 0").join(known.hint("merge"), ["k0", "k1"]).select("did", "k0", "k1", "rows", "class_id")
    out = saved(out.union(rows.where("n = 0").select("did", "k0", "k1", "rows", F.col("did").alias("class_id"))), "classes")
    drop(light, reps, data, links, more, joined, mixed)
    return out


def dedup(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """docs with one document of each class, that of the least id, in all its columns; of repeated rows one stays."""
    found = classes(docs, least)
    stay = found.where("did = class_id").select("did", "k0", "k1", "rows")
    d = docs.select(F.struct(*docs.columns).alias("row"), *_keys()).join(stay, ["did", "k0", "k1"])
    if not stay.where("rows > 1").isEmpty():
        d = d.where("rows = 1").unionByName(d.where("rows > 1").dropDuplicates(["did", "k0", "k1"]))
    return d.select("row.*")


def op1_order_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classes(docs).select("did", "rows", "class_id")
    d = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return d.select(F.col("did").alias("doc_id"), "class_id", ((F.col("did") == F.col("class_id")) & (F.col("copy") == 1)).alias("kept"))
