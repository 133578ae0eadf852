"""Document fingerprints from closed syncmers, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


K, S = 16, 5  # bytes in a k-mer and in its inner substrings: of random places 2 in 12 are anchors
CHUNK = 4096  # bytes worked on at once
FEW = 64
ROWS, PARTS = 512, 128  # documents in a range at least; at most PARTS * PARTS ranges


def _let(value: Column, body) -> Column:
    """body(value), the value computed once: a lambda's variable is all that SQL has for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low31(data: Column) -> Column:
    return F.xxhash64(data).bitwiseAND(F.lit(0x7FFFFFFF))


def _chunk(data: Column, start: Column) -> Column:
    """Anchors of one chunk: of each k-mer whose least inner hash stands first or last, its hash << 32 | position."""
    width = K - S + 1
    assert width == 12

    def least(h: Column, step: int, then) -> Column:  # at the end null stands in, which least() passes over
        return _let(F.transform(h, lambda x, i: F.least(x, F.get(h, i + step))), then)

    def picked(h: Column, m: Column) -> Column:
        edge = F.filter(F.sequence(F.lit(0), F.length(data) - K), lambda i: F.get(m, i).isin(F.get(h, i), F.get(h, i + (width - 1))))
        return F.transform(edge, lambda i: F.shiftleft(_low31(F.substring(data, i + 1, F.lit(K))), 32).bitwiseOR((start + i).cast("long")))

    def anchors(h: Column) -> Column:
        return least(h, 1, lambda two: least(two, 2, lambda four: least(four, 4, lambda eight: least(eight, 4, lambda m: picked(h, m)))))

    hashes = F.transform(F.sequence(F.lit(1), F.length(data) - (S - 1)), lambda i: F.xxhash64(F.substring(data, i, F.lit(S))))
    return F.when(F.length(data) >= K, _let(hashes, anchors)).otherwise(F.array().cast("array<bigint>"))


def anchors(data: Column) -> Column:
    """All closed syncmers of binary data as array<bigint>: hash << 32 | position from 0.

    Whether a k-mer is one depends on its own bytes only. Data shorter than K are their own
    k-mer; empty data have none.
    """

    def searched(held: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(held) - K, F.lit(0)), F.lit(CHUNK))
        return F.flatten(F.transform(starts, lambda at: _let(F.substring(held, at + 1, F.lit(CHUNK + K - 1)), lambda part: _chunk(part, at))))

    every = _let(data, searched)
    whole = F.array(F.shiftleft(_low31(data), 32))
    return F.when(F.length(data) >= K, every).when(F.length(data) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def lowest(found: Column) -> Column:
    """All anchors, those of lowest hash first; of equal hashes the first position first."""
    return F.sort_array(found)


def text_of(sketch: Column) -> Column:
    """Anchors as text: hexadecimal numbers, the last 8 digits of each the byte position, those before it the hash."""
    return F.array_join(F.transform(sketch, lambda x: F.hex(x)), " ")


def _hash_of(sketch: Column) -> Column:
    return F.transform(sketch, lambda x: F.shiftright(x, 32))


def firsts(sketch: Column) -> Column:
    """Of equal hashes the first position; sketch is sorted as lowest() does."""

    def kept(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(s, i - 1), 32)))
        return F.when(F.size(F.array_distinct(_hash_of(s))) == F.size(s), s).otherwise(first)

    return _let(sketch, kept)


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of two texts that both have at one offset, the one that most agree on. Two empty ones: 1.

    a and b as firsts() makes them. If at least half of the common hashes stand at the same place, no other offset
    can have more; only else the offsets are counted: up to FEW common hashes are looked up one by one, more are put
    side by side in one sorted array, with the same result.
    """
    place = lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF))

    def offsets(m: Column) -> Column:  # equal hashes stand side by side
        pairs = F.filter(F.transform(m, lambda x, i: F.when(F.shiftright(x, 32) == F.shiftright(F.get(m, i + 1), 32), place(F.get(m, i + 1)) - place(x))), lambda x: x.isNotNull())
        return F.sort_array(pairs)

    def most(found: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            run = F.when(s["at"].eqNullSafe(x), s["run"] + 1).otherwise(F.lit(1))
            return F.struct(x.alias("at"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

        return F.aggregate(found, F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda s: s["best"])

    def looked_up(x: Column, y: Column, hx: Column, hy: Column, common: Column) -> Column:
        at = lambda s, hs, h: place(F.get(s, (F.array_position(hs, h) - 1).cast("int")))
        return F.sort_array(F.transform(common, lambda h: at(y, hy, h) - at(x, hx, h)))

    def share(x: Column, y: Column, hx: Column, hy: Column, common: Column) -> Column:
        both, same = F.size(common), F.size(F.array_intersect(x, y))
        marked = F.transform(y, lambda v: v.bitwiseOR(F.lit(0x80000000)))
        several = _let(F.sort_array(F.concat(x, marked)), lambda m: most(offsets(m)))
        few = _let(looked_up(x, y, hx, hy, common), most)
        every = F.size(x) + F.size(y) - both
        agree = F.when(both == 0, 0).otherwise(_let(same, lambda n: F.when(2 * n >= both, n).when(both <= FEW, few).otherwise(several)))
        return F.when(every == 0, F.lit(1.0)).otherwise(agree / every)

    def compared(x: Column, y: Column) -> Column:
        return _let(_hash_of(x), lambda hx: _let(_hash_of(y), lambda hy: _let(F.array_intersect(hx, hy), lambda c: share(x, y, hx, hy, c))))

    return _let(a, lambda x: _let(b, lambda y: compared(x, y)))


def _ranged(docs: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ranges of the key (column bucket), and copy each range's top rows to the range above (ghost).

    The bounds are quantiles, at most PARTS * PARTS numbers; they only decide where rows go.
    """
    count, low, high = docs.agg(F.count(key), F.min(key), F.max(key)).first()
    n = max(1, min(PARTS, int((count / ROWS) ** 0.5 + 1)))
    bounds = []
    if count:
        cuts = [i / (n * n) for i in range(1, n * n)]
        bounds = sorted({*(docs.agg(F.percentile_approx(key, cuts, 10 * n * n).alias("x")).first()["x"] or [] if cuts else [])} - {high})
    rows = [bounds[i : i + n] for i in range(0, len(bounds), n)]
    if rows:
        over = lambda part: F.size(F.filter(part, lambda b: b < F.col(key)))
        lits = F.array(*[F.array(*[F.lit(b).cast("long") for b in r]) for r in rows])
        outer = F.size(F.filter(F.array(*[F.lit(r[0]).cast("long") for r in rows]), lambda b: b < F.col(key)))
        inner = F.when(outer > 0, (outer - 1) * n + over(F.get(lits, outer - 1))).otherwise(0)
        bucket = F.coalesce(inner, F.lit(0))
    else:
        bucket = F.lit(0)
    d = docs.withColumn("bucket", bucket.cast("int"))
    tops = d.groupBy("bucket").agg(F.max(key).alias("top"))
    every = Window.orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.withColumn("above", above).withColumnRenamed("bucket", "b")  # at most PARTS * PARTS + 1 rows
    d = d.join(F.broadcast(tops), (d.bucket == tops.b) & d[key].eqNullSafe(tops.top), "left").drop("b", "top")
    copies = F.filter(F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("above").alias("bucket"), F.lit(True).alias("ghost"))), lambda x: x["bucket"].isNotNull())
    return d.withColumn("to", F.explode(copies)).select(*docs.columns, "to.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id (integer), text; other columns are ignored. One row for each row of docs.

    Each text (null: empty) gets a fingerprint, all its anchors with their positions, by hash (see text_of()). So
    does its edited text: the last floor(n_chars/3) code points give way to the first as many (or all) of
    the next document in descending doc_id; after the last comes the first, and a lone document follows
    itself. Rows with one doc_id follow each other by text; a null doc_id comes last. An empty table
    gives an empty result.

    Anchors don't depend on context, so the edited text's are those of the two parts and of the K-1 bytes
    on either side of the seam; each text is searched once. Rows go by range of doc_id to where their
    neighbours are: one shuffle of the texts, balanced whatever the ids are.
    """
    d = _ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("need", F.floor(F.lag("n_chars").over(order) / 3).cast("int"))
    keep, head = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")), F.substring("text", F.lit(1), F.coalesce("need", F.lit(0)))
    d = d.select("bucket", "ghost", "doc_id", "text", "n_chars", keep.alias("keep"), head.alias("head"), anchors(F.col("text").cast("binary")).alias("found"))
    upto = lambda part: F.filter("found", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)) + K <= F.octet_length(part))
    d = d.select("bucket", "ghost", "doc_id", "text", "n_chars", "keep", "head", lowest(F.col("found")).alias("own"), upto("keep").alias("kept"), upto("head").alias("taken"))
    d = d.withColumn("firsts", firsts(F.col("own")))
    ahead = lambda c: F.lead(c).over(order)
    d = d.select("ghost", "doc_id", "n_chars", "keep", "own", "firsts", "kept", ahead("head").alias("head"), ahead("taken").alias("taken"), ahead("firsts").alias("next")).where("not ghost")
    edited = F.concat("keep", "head").cast("binary")
    size = F.octet_length("keep")
    seam = F.greatest(size - (K - 1), F.lit(0))
    d = d.withColumn("edited", edited).withColumn("seam", F.substring("edited", seam + 1, size - seam + K - 1))
    # of the seam's k-mers those that lie in one part are among that part's
    crossing = F.transform(F.filter(F.when(F.length("seam") >= K, anchors(F.col("seam"))).otherwise(F.array().cast("array<bigint>")), lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) + seam + K > size) & (x.bitwiseAND(F.lit(0xFFFFFFFF)) + seam < size)), lambda x: x + seam)
    merged = lowest(F.concat("kept", crossing, F.transform("taken", lambda x: x + size)))
    d = d.withColumn("changed", F.when(F.length("edited") >= K, merged).otherwise(anchors(F.col("edited"))))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("own")).alias("fingerprint"), text_of(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("firsts"), firsts(F.col("changed"))).alias("near_edited"), likeness(F.col("firsts"), F.col("next")).alias("near_next"))


def op8_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
