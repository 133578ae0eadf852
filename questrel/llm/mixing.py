"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
PLACES = 4096  # parts of the random numbers' range, and of a part: the two steps of the search for a threshold
SALTS = 32
RUNS, NEAREST = 2, 3  # passes that take documents by rank as long as they fit; last places after them


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends only on the key: 48 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds weight and target (double).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. A target stops at `most` times
    its source's size; what is over goes to the others by weight, until none is above. Seen by rising
    size/weight, the sources that stop are a prefix, so running sums give every target at once. The
    windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    d = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    d = d.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    d = d.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
    d = d.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
    d = d.withColumn("level", F.col("left") / F.col("weights"))
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return d.withColumn("level", level).select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def _drawn(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, source, skey, text_key, size, u: a row for each row of docs, with a random number of its own.

    The number comes from the MD5 of doc_id, the text's MD5 and, of rows that are equal in these and the source,
    the row's number. Equal rows are counted before the shuffle and numbered by a sequence, without a sort.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select("doc_id", "source", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("text_key"), size.alias("size"))
    d = d.groupBy(*d.columns).agg(F.count("*").cast("int").alias("rows")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    named = F.concat_ws(":", F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "text_key", F.col("row").cast("string"))
    return d.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"), "text_key", "size", uniform(named).alias("u"))


def _odds() -> Column:
    return (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))


def _inside() -> Column:
    """Whether a pass has taken the document: it was no longer than what then remained, and ranked by the threshold."""
    return F.exists("cuts", lambda c: (F.col("size") <= c["rest"]) & (F.col("u") <= c["u"])) | F.exists("picked", lambda x: x == F.col("u"))


def _run(base: DataFrame, plan: DataFrame) -> DataFrame:
    """plan after one more pass: of each source the documents left that are no longer than the rest, taken by rank as
    long as they fit.

    The ranking is never sorted as a whole: words are summed by 1/4096 of the random numbers' range, then by 1/4096
    of the part where the threshold lies; only what is in that part's part is sorted.
    """
    left = base.join(_salted(plan), ["skey", "salt"]).where("f > 0 and size > 0 and size <= rest").where(~_inside())
    found = plan.select("skey", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("part"), F.lit(False).alias("all"))
    for parts in (PLACES, PLACES * PLACES):
        part = F.floor(F.col("u") * parts)
        sums = left.withColumn("p", part).groupBy("skey", "p").agg(F.sum("size").alias("words"))
        sums = sums.join(found, "skey").where(F.lit(parts == PLACES) | (F.floor(F.col("p") / PLACES) == F.col("part")))
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("skey").orderBy("p")))
        edge = sums.where("upto > rest").groupBy("skey").agg(F.min_by(F.struct(F.col("p").alias("part"), (F.col("upto") - F.col("words")).alias("before")), "p").alias("x"))
        found = saved(plan.select("skey", "rest").join(edge.select("skey", "x.*"), "skey"), "edges")
    rank = Window.partitionBy("skey").orderBy("odds").rangeBetween(Window.unboundedPreceding, 0)
    last = left.drop("rest").join(_salted(found), ["skey", "salt"]).where(F.floor(F.col("u") * (PLACES * PLACES)) == F.col("part")).withColumn("odds", _odds())
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(rank)).where("upto <= rest")
    last = last.groupBy("skey").agg(F.max("u").alias("u"), F.max("upto").alias("got"))
    every = left.groupBy("skey").agg(F.sum("size").alias("words"))
    d = plan.join(found.drop("rest"), "skey", "left").join(last, "skey", "left").join(every, "skey", "left")
    # a source whose words all fit has no threshold
    cut = F.when(F.col("part").isNull(), 1.0).otherwise(F.coalesce("u", F.col("part") / (PLACES * PLACES)))
    got = F.when(F.col("part").isNull(), F.coalesce("words", F.lit(0))).otherwise(F.coalesce("got", "before"))
    return saved(d.select("skey", "f", F.concat("cuts", F.array(F.struct("rest", cut.alias("u")))).alias("cuts"), "picked", (F.col("rest") - got).alias("rest")), "plan")


def _nearest(base: DataFrame, plan: DataFrame) -> DataFrame:
    """plan after one more place: that of the document left whose size comes closest to the rest, if that brings it nearer to 0."""
    left = base.join(_salted(plan), ["skey", "salt"]).where("f > 0 and size > 0 and abs(size - rest) < rest").where(~_inside())
    best = left.withColumn("odds", _odds()).groupBy("skey").agg(F.min(F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), "odds", "u", "size")).alias("x"))
    d = plan.join(best, "skey", "left")
    more = F.when(F.col("x").isNotNull(), F.array("x.u")).otherwise(F.array().cast("array<double>"))
    return saved(d.select("skey", "f", "cuts", F.concat("picked", more).alias("picked"), (F.col("rest") - F.coalesce("x.size", F.lit(0))).alias("rest")), "plan")


def _mixed(docs: DataFrame, share: float, most: float, seed: str) -> DataFrame:
    base = saved(_drawn(docs, seed).withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")), "mix")
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("certain", F.floor(rate).cast("long")).withColumn("f", rate - F.floor(rate))
    plan = plan.withColumn("want", F.col("target") - F.col("certain") * F.col("source_size"))
    plan = saved(plan.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source", "weight"), "plan")
    steps = plan.select("skey", "f", F.array().cast("array<struct<rest:double,u:double>>").alias("cuts"), F.array().cast("array<double>").alias("picked"), F.col("want").alias("rest"))
    for step in [_run] * RUNS + [_nearest] * NEAREST:
        steps = step(base, steps)
    d = base.join(_salted(plan.drop("f", "want").join(steps.drop("rest"), "skey")), ["skey", "salt"])
    extra = ((F.col("f") > 0) & _inside()).cast("long")
    copies = F.when(F.col("size") > 0, F.col("certain") + extra).otherwise(0).cast("long")
    return d.select("doc_id", "source", "text_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, share: float = 1.0, most: float = 3.0, seed: str = "") -> DataFrame:
    """Which documents a mix of the sources takes, and how often.

    docs: doc_id, source, text; other columns are ignored. Returns doc_id, source, size (words, null
    text: 0), source_size, target, copies (long) and taken = copies * size, a row for each row of docs.

    A source whose target is r times its size takes floor(r) certain copies of each document. The rest,
    f = r - floor(r), is the inclusion probability of one more copy: documents are ranked by their random
    odds u/(1-u) over the inclusion odds f/(1-f), and the first are taken as long as they fit the words
    that remain; then, in a second pass, those of the others that are short enough. Last places go,
    one after another, to the document left whose size comes closest to what then remains, while that
    brings the sum nearer. The sample's size is fixed in words, not in documents. Reruns agree; rows that
    repeat a doc_id (null included) and text have numbers of their own. Empty tables give empty results;
    a source without words takes nothing.

    A source with a third of all rows is summed before the shuffle, and joins to it are salted.
    """
    return _mixed(docs, share, most, seed).drop("text_key")


def repeat(docs: DataFrame, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """docs with each row as often as mix() takes it; documents without words are taken never.

    Of rows equal in doc_id, source and text each is there as often as the one taken least, and one of them
    as often again as the mix takes more.
    """
    keys = ["doc_id", "source", "text_key"]
    picked = _mixed(docs, share, most, "").groupBy(*keys).agg(F.min("copies").cast("int").alias("each"), (F.sum("copies") - F.min("copies") * F.count("*")).cast("int").alias("more"))
    picked = saved(picked.where("each + more > 0"), "picked")
    named = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("i"), F.col("source").alias("s"), named.alias("k"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("text_key"))
    often = lambda c: F.explode(F.sequence(F.lit(1), F.col(c)))
    every = d.join(picked.where("each > 0"), same).select("row", often("each")).select("row.*")
    one = d.join(picked.where("more > 0"), same).dropDuplicates(["i", "s", "k"]).select("row", often("more")).select("row.*")
    return every.unionByName(one)


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def op6_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    steps, before = [], "drawn"
    for i in range(RUNS):
        steps.append(f"""
e{i} AS (SELECT *, f > 0 AND NOT inside AND size > 0 AND size <= rest AS fits FROM {before}),
u{i} AS (SELECT *, fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds) <= rest AS took FROM e{i}),
r{i} AS (SELECT * EXCLUDE (fits, took) REPLACE (inside OR took AS inside, rest - coalesce(sum(CASE WHEN took THEN size END) OVER (PARTITION BY source), 0) AS rest) FROM u{i}),""")
        before = f"r{i}"
    for i in range(NEAREST):
        steps.append(f"""
c{i} AS (SELECT *, f > 0 AND NOT inside AND size > 0 AND abs(size - rest) < rest AS fits FROM {before}),
b{i} AS (SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - rest), odds) = 1 AS took FROM c{i}),
n{i} AS (SELECT * EXCLUDE (fits, took) REPLACE (inside OR took AS inside, rest - coalesce(sum(CASE WHEN took THEN size END) OVER (PARTITION BY source), 0) AS rest) FROM b{i}),""")
        before = f"n{i}"
    return FIRST_SQL + "".join(steps).rstrip(",") + f"""
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (certain + CASE WHEN inside THEN 1 ELSE 0 END) * size ELSE 0 END::BIGINT AS taken FROM {before}"""


FIRST_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null') || ':' || row_number() OVER (PARTITION BY doc_id, source, text)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM base GROUP BY source),
ratios AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER w, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level)), cap) AS target FROM levels),
rates AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS certain,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS f FROM plan),
drawn AS (
  SELECT b.doc_id, b.size, r.*, r.target - r.certain * r.source_size AS rest, (b.u / (1 - b.u)) / (r.f / (1 - r.f)) AS odds, false AS inside
  FROM base b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source),"""

SQL = _sql()
