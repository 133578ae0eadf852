"""Substring dedup: interval expansion on a Burrows-Wheeler transform, stopped at the least length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, saved

LENGTH = 200
GRAM = 32  # bytes of the anchor that each window is filed under
CHUNK = 1 << 20  # bytes of a text searched for anchors at once
BATCH = 384 << 10  # bytes in one transform, about; its arrays then fit the processor's caches
LARGE = 4096  # distinct pieces of an anchor beyond which its windows are compared by halving
NONE = (1 << 63) - 1


# ---- anchors: which windows can be equal at all


def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(CHUNK + LENGTH + 1, x, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POWERS: list = []


def runs(data: bytes) -> list[tuple[int, int, int]]:
    """(anchor, first, count): the windows of LENGTH bytes in order, those with one anchor in a row together.

    A window's anchor is the leftmost of its GRAM-byte strings with the least hash. It depends on the
    window's bytes only, so equal windows have equal anchors, wherever they stand.
    """
    if not _POWERS:
        _POWERS.extend(_powers())
    up, down = _POWERS
    out = []
    every = np.frombuffer(data, np.uint8)
    for base in range(0, len(data) - LENGTH + 1, CHUNK):
        b = every[base : base + CHUNK + LENGTH - 1].astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)])])
            h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        mask = np.uint64((1 << 21) - 1)
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
        wide, have = LENGTH - GRAM + 1, 1
        while have < wide:
            step = min(have, wide - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        at = (key & mask).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        count = np.diff(np.concatenate([first, [len(at)]]))
        anchors = h[at[first]].astype(np.int64)
        out += zip(anchors.tolist(), (first + base).tolist(), count.tolist(), strict=True)
    return out


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _emit(batches):
    for b in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for did, th, text in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            found = runs(data)
            cols[0] += [did] * len(found)
            cols[1] += [th] * len(found)
            cols[2] += [h for h, _, _ in found]
            cols[3] += [_digest(data[s : s + n + LENGTH - 1]) for _, s, n in found]
            cols[4] += [s for _, s, _ in found]
            cols[5] += [n for _, _, n in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 4 + (pa.int32(),) * 2, strict=True)], ["did", "th", "h", "pd", "s", "n"])


# ---- the transform


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least, by doubling; what is past the end is least."""
    n = len(text)
    have = 7  # bytes packed into one number
    wide = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(have, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(have):
        key = (key << np.uint64(9)) | wide[j : j + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if have >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new.astype(np.uint64) + np.uint64(1)
        key = (rank << np.uint64(32)) | np.concatenate([rank[have:], np.zeros(min(have, n), np.uint64)])
        have *= 2


def long_neighbours(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each place in it whether its suffix shares `least` bytes with the one before.

    Breadth first: from the interval of the empty string, each interval of a string w is extended backward
    by the bytes that precede it in the transform, to the interval of cw. Where that ends for the first
    time at some place, the common prefix there is as long as w. Prefixes thus come by increasing value;
    places still open after the value least - 1 share at least `least`.
    """
    n = len(text)
    order = suffix_array(text, least + 1)
    bwt = text[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    still = np.ones(n + 1, bool)
    still[[0, n]] = False
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        alone = back[low[size == 1]]  # one suffix: nothing to sort
        low, size = low[size > 1], size[size > 1]
        which = np.repeat(np.arange(len(low)), size)
        at = np.arange(size.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        key = which * 256 + bwt[at]
        by = np.argsort(key)
        ranked = key[by]
        first = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
        low = np.minimum.reduceat(back[at[by]], first) if len(by) else low
        high = low + np.diff(np.concatenate([first, [len(by)]])) if len(by) else low
        low, high = np.concatenate([low, alone]), np.concatenate([high, alone + 1])
        fresh = still[high]
        low, high = low[fresh], high[fresh]
        still[high] = False
    return order, still[:n]


def repeated(pieces: list[bytes], least: int = LENGTH) -> list[np.ndarray]:
    """For each piece which of its windows occurs elsewhere among the pieces. Pieces are UTF-8, cut anywhere."""
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no byte of UTF-8
    order, same = long_neighbours(text, least)
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    out, at = [], 0
    for p in pieces:
        out.append(hit[at : at + max(0, len(p) - least + 1)])
        at += len(p) + 1
    return out


def _ranges(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"o": int(a), "n": int(b - a)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


FOUND = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32())]))


def _resolve(batches):
    """Pieces sorted by anchor: transforms of whole groups, several together."""
    held: list = []
    size, last = 0, None

    def done():
        hits = repeated([d for _, _, d in held])
        rows = [(h, pd, r) for (h, pd, _), hit in zip(held, hits, strict=True) if (r := _ranges(hit))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], FOUND)], ["h", "pd", "found"])

    for b in batches:
        for h, pd, data in zip(b.column("h").to_pylist(), b.column("pd").to_pylist(), b.column("data").to_pylist(), strict=True):
            if size > BATCH and h != last:
                yield done()
                held, size = [], 0
            held.append((h, pd, data))
            size, last = size + len(data), h
    if held:
        yield done()


def _halves(batches):
    """Ranges of windows of pieces, halved; with hashes of a range's bytes and of those all its windows share."""
    for b in batches:
        rows = []
        for h, pd, data, o, a, z in zip(*(b.column(c).to_pylist() for c in ("h", "pd", "data", "o", "lo", "hi")), strict=True):
            mid = (a + z) // 2
            for lo, hi in ((a, mid), (mid, z)) if z - a > 1 else ((a, z),):
                own = (max(lo, o), min(hi, o + len(data) - LENGTH + 1))  # a range of places of the anchor, as far as the piece has it
                if own[0] < own[1]:
                    part = data[own[0] - o : own[1] - 1 - o + LENGTH]
                    core = data[max(0, hi - 1 - o) : lo + LENGTH - o]
                    rows.append((h, pd, data, o, lo, hi, own[0], own[1], _digest(part), _digest(core)))
        kinds = (pa.int64(), pa.int64(), pa.binary(), *(pa.int32(),) * 5, pa.int64(), pa.int64())
        names = ["h", "pd", "data", "o", "lo", "hi", "w0", "w1", "part", "core"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _pieces(batches):
    for b in batches:
        cols: list[list] = [[], [], []]
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                part = data[w["s"] : w["s"] + w["n"] + LENGTH - 1]
                cols[0].append(w["h"])
                cols[1].append(w["pd"])
                cols[2].append(part)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["h", "pd", "data"])


def _placed(batches):
    for b in batches:
        places = [_place(d, h) for d, h in zip(b.column("data").to_pylist(), b.column("h").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("pd"), b.column("data"), pa.array(places, pa.int32())], ["h", "pd", "data", "o"])


def _place(part: bytes, anchor: int) -> int:
    """Minus the anchor's place in the piece, plus LENGTH: equal windows of two pieces have equal o + window."""
    b = np.frombuffer(part, np.uint8).astype(np.uint64)
    up, down = _POWERS or (_POWERS.extend(_powers()) or _POWERS)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)])])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    n = len(part) - LENGTH + 1  # the anchor lies in every window, the leftmost such in each
    at = np.flatnonzero(h.astype(np.int64) == anchor)
    return LENGTH - int(at[(at >= n - 1) & (at <= LENGTH - GRAM)][0])


def _cut(batches):
    for b in batches:
        n_bytes, removed, spans, shas, texts = [], [], [], [], []
        for text, hits in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            step = np.zeros(len(data) + 1, np.int64)
            for x in hits or ():
                step[x["s"]] += 1
                step[x["s"] + x["n"] + LENGTH - 1] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            n_bytes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _halved(pieces: DataFrame) -> DataFrame:
    """(h, pd, found) for pieces of very frequent anchors, exactly, in rounds whose rows grow with the pieces only.

    Equal windows of two pieces stand alike to the anchor. A range of such places is settled if two pieces
    have the same bytes there; it is halved if two share what all its windows contain; else nothing in it is
    equal. Both are aggregates, so no group comes together in a task.
    """
    open_ = pieces.select("h", "pd", "data").mapInArrow(_placed, "h long, pd long, data binary, o int")
    open_ = open_.select("h", "pd", "data", "o", F.lit(0).alias("lo"), F.lit(LENGTH + 1).alias("hi"))
    settled = None
    for _ in range(LENGTH.bit_length() + 1):
        halves = saved(open_.mapInArrow(_halves, "h long, pd long, data binary, o int, lo int, hi int, w0 int, w1 int, part long, core long"), "halves")
        if halves.isEmpty():
            break
        place = ["h", "lo", "hi"]
        same = saved(halves.groupBy(*place, "w0", "w1", "part").agg(F.count("*").alias("c"), F.min("pd").alias("one")).where("c > 1").drop("c"), "same")
        hit = saved(halves.join(same, [*place, "w0", "w1", "part"], "left"), "hit")
        now = hit.where("one is not null").select("h", "pd", (F.col("w0") - F.col("o")).alias("o"), (F.col("w1") - F.col("w0")).alias("n"))
        settled = now if settled is None else settled.union(now)
        left = hit.where("hi - lo > 1 and (one is null or one = pd)")  # one of those alike stays for the others to meet
        near = left.groupBy(*place, "core").agg(F.min("pd").alias("a"), F.max("pd").alias("b"), F.max(F.col("one").isNull()).alias("open")).where("a != b and open").select(*place, "core")
        open_ = left.join(saved(near, "near"), [*place, "core"], "left_semi").select("h", "pd", "data", "o", "lo", "hi")
    return settled.groupBy("h", "pd").agg(F.collect_list(F.struct(F.col("o").cast("int").alias("o"), F.col("n").cast("int").alias("n"))).alias("found")) if settled is not None else None


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. A row for each row: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept (the bytes left). Removed is each byte in a string of LENGTH bytes that also starts
    anywhere else in any text (UTF-8, null: empty); nothing crosses texts. Texts shorter than that stay whole.
    Rows that repeat doc_id and text count as two texts. An empty table gives an empty result.

    Windows are filed under an anchor that depends on their bytes only, about 85 in a row together as a
    piece. Anchors that occur once are dropped, pieces that occur twice are repeated throughout; both by
    aggregates of hashes. Only the different pieces of one anchor meet as bytes, in transforms of about BATCH
    bytes; anchors with over LARGE different pieces go another exact way (see _halved()).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    th = F.xxhash64("text").alias("th")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(NONE)).alias("did"), th, "text")
    rows = saved(d.where(F.octet_length("text") >= LENGTH).select("did", "th", "text").mapInArrow(_emit, "did long, th long, h long, pd long, s int, n int"), "runs")
    twice = saved(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "twice")
    rows2 = saved(rows.join(twice, "h"), "runs")
    drop(rows, twice)
    kinds = saved(rows2.groupBy("h", "pd").agg(F.count("*").alias("c"), F.min(F.struct("did", "th", "s", "n")).alias("at")), "kinds")
    several = saved(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    meet = saved(kinds.join(several, "h"), "meet")
    wanted = meet.groupBy(F.col("at.did").alias("did"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct("h", "pd", F.col("at.s").alias("s"), F.col("at.n").alias("n"))).alias("wanted"))
    pieces = d.select("did", "th", "text").join(wanted, ["did", "th"]).select("text", "wanted").mapInArrow(_pieces, "h long, pd long, data binary")
    pieces = saved(pieces.join(several, "h"), "pieces")
    drop(meet, several)
    solved = pieces.where(F.col("kinds") <= LARGE).select("h", "pd", "data").repartition("h").sortWithinPartitions("h").mapInArrow(_resolve, "h long, pd long, found array<struct<o:int,n:int>>")
    solved = saved(solved, "solved")
    large = pieces.where(F.col("kinds") > LARGE)
    if not large.isEmpty() and (more := _halved(large)) is not None:
        first, solved = solved, saved(solved.unionByName(more), "solved")
        drop(first)
    drop(pieces)
    every = F.array(F.struct(F.lit(0).alias("o"), (F.col("n")).alias("n")))
    full = saved(kinds.where("c > 1").select("h", "pd"), "full")
    marks = full.withColumn("found", F.lit(None).cast("array<struct<o:int,n:int>>")).unionByName(solved.join(full, ["h", "pd"], "left_anti"))
    marks = saved(marks, "marks")
    drop(kinds, solved, full)
    hits = rows2.join(marks, ["h", "pd"]).select("did", "th", "s", F.explode(F.coalesce("found", every)).alias("f"))
    hits = hits.groupBy("did", "th").agg(F.collect_set(F.struct((F.col("s") + F.col("f.o")).alias("s"), F.col("f.n").alias("n"))).alias("hits"))
    out = d.join(hits, ["did", "th"], "left").select("doc_id", "text", "hits")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_bwt_intervals(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
