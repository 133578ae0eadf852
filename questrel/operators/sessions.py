"""Workers' sessions: open, close, expire; grant, surrender and count quota; deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import TIMEOUT


def open_sessions(requests: DataFrame, serials: DataFrame | None = None, timeout: int = 300) -> DataFrame:
    """requests: worker, time (seconds), seq. Returns worker, session, exp_time.

    Ids count up from the worker's serial (serials: worker, serial), which never falls.
    """
    number = F.row_number().over(Window.partitionBy("worker").orderBy("seq"))
    d = requests.withColumn("n", number)
    if serials is not None:
        d = d.join(serials, "worker", "left").withColumn("n", F.col("n") + F.coalesce("serial", F.lit(0)))
    return d.select("worker", F.col("n").cast("long").alias("session"), (F.col("time") + timeout).cast("long").alias("exp_time"))


def session_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("worker").agg(F.count("*").alias("sessions"))


def expired_sessions(sessions: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Sessions whose exp_time is before now (equal: still alive), the earliest `limit` of them."""
    d = sessions.where(F.col("exp_time") < now)
    return d.orderBy("exp_time", "worker", "session").limit(limit) if limit is not None else d


def next_expiry(sessions: DataFrame) -> DataFrame:
    """One row: the earliest exp_time, 0 without sessions."""
    return sessions.agg(F.coalesce(F.min("exp_time"), F.lit(0)).alias("next_expiry"))


def watchdog_sleep(next_exp: int, now: int, interval: float = 10, timeout: float = 300) -> float:
    """Seconds until the next look for expired sessions."""
    if not next_exp:
        return timeout
    return max(0.0, min(next_exp - now, interval))


def close_sessions(sessions: DataFrame, closing: DataFrame, queue: DataFrame, quotas: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Removes the sessions in closing (worker, session). Returns (sessions, queue, results, quotas).

    A worker that loses its last session loses its queue too: each row of it, delivered or not, becomes a
    result of status 2. Unknown sessions change nothing. quotas (worker, session, quota): a closed session's
    credit goes with it.
    """
    key = ["worker", "session"]
    left = sessions.join(closing.select(*key).distinct(), key, "left_anti")
    gone = sessions.join(closing.select(*key).distinct(), key, "left_semi").select("worker").distinct().join(left.select("worker").distinct(), "worker", "left_anti")
    results = queue.join(gone, "worker", "left_semi").select("worker", "offset", "item", F.lit(TIMEOUT).alias("status"), "exp_time")
    return left, queue.join(gone, "worker", "left_anti"), results, quotas.join(left.select(*key), key, "left_semi") if quotas is not None else None


def expire_sessions(sessions: DataFrame, queue: DataFrame, now: int, limit: int | None = 16, quotas: DataFrame | None = None):
    return close_sessions(sessions, expired_sessions(sessions, now, limit), queue, quotas)


def dead_letter(queue: DataFrame, sessions: DataFrame) -> DataFrame:
    """Queued rows of workers without sessions, as results of status 2."""
    return queue.join(sessions.select("worker").distinct(), "worker", "left_anti").select("worker", "offset", "item", F.lit(TIMEOUT).alias("status"), "exp_time")


def grant(quotas: DataFrame, grants: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adds grants (worker, session, n) to the quotas (worker, session, quota) of live sessions.

    Returns (quotas, granted, rejected): granted has total, the session's quota, and added; rejected are
    grants of 0 or less and of unknown sessions.
    """
    key = ["worker", "session"]
    live = sessions.select(*key).distinct()
    good = grants.where("n > 0").join(live, key, "left_semi")
    bad = grants.where("n is null or n <= 0").unionByName(grants.where("n > 0").join(live, key, "left_anti"))
    added = good.groupBy(*key).agg(F.sum("n").alias("added"))
    out = quotas.join(added, key, "full_outer").withColumn("quota", (F.coalesce("quota", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("long"))
    return out.select(*key, "quota"), out.where("added is not null").select(*key, F.col("quota").alias("total"), "added"), bad


def surrender(quotas: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets sessions' quotas to 0. Returns (quotas, removed): what each had."""
    key = ["worker", "session"]
    asked = requests.select(*key).distinct().withColumn("asked", F.lit(True))
    d = quotas.join(asked, key, "left")
    return d.select(*key, F.when(F.col("asked"), 0).otherwise(F.col("quota")).cast("long").alias("quota")), d.where("asked").select(*key, F.col("quota").alias("removed"))


def pending(quotas: DataFrame, requests: DataFrame) -> DataFrame:
    """Each asked session's quota, 0 for an unknown one."""
    return requests.select("worker", "session").distinct().join(quotas, ["worker", "session"], "left").select("worker", "session", F.coalesce("quota", F.lit(0)).alias("pending"))


def worker_quotas(quotas: DataFrame) -> DataFrame:
    return quotas.groupBy("worker").agg(F.sum("quota").alias("quota"))


def running_quota(changes: DataFrame) -> DataFrame:
    """changes: worker, seq, delta. Adds quota, the worker's sum up to each change."""
    w = Window.partitionBy("worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("quota", F.sum("delta").over(w))


def deliver(queue: DataFrame, sessions: DataFrame, batch: int = 1024) -> DataFrame:
    """The first rows of each worker's queue that aren't delivered yet, dealt to its sessions in order of id.

    sessions: worker, session, quota. A session gets up to its quota and `batch` rows. An empty item is an error.
    """
    order = Window.partitionBy("worker").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    s = sessions.withColumn("size", F.least("quota", F.lit(batch))).where("size > 0")
    s = s.withColumn("upto", F.sum("size").over(order)).withColumn("from", F.col("upto") - F.col("size"))
    place = F.row_number().over(Window.partitionBy("worker").orderBy("offset")) - 1
    fresh = queue.where(~F.coalesce(F.col("delivered"), F.lit(False))) if "delivered" in queue.columns else queue
    q = fresh.withColumn("place", place).join(s.select("worker", "session", "from", "upto"), "worker").where("place >= from and place < upto")
    item = F.when(F.col("item") != "", F.col("item")).otherwise(F.raise_error(F.concat(F.lit("empty item at offset "), F.col("offset").cast("string"))))
    return q.select("worker", "session", "offset", item.alias("item"), "exp_time")


def commit_delivery(queue: DataFrame, sessions: DataFrame, quotas: DataFrame, delivered: DataFrame, now: int, timeout: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What deliver() changes: (queue, sessions, quotas). Delivered rows are marked so (column delivered), their
    sessions live on until now + timeout, and lose as much quota; a quota of 0 or less goes."""
    key = ["worker", "session"]
    taken = delivered.groupBy(*key).agg(F.count("*").alias("_n"))
    rows = delivered.select("worker", "offset").distinct().withColumn("_now", F.lit(True))
    was = F.coalesce("delivered", F.lit(False)) if "delivered" in queue.columns else F.lit(False)
    q = queue.withColumn("delivered", was).join(rows, ["worker", "offset"], "left")
    q = q.withColumn("delivered", F.col("delivered") | F.coalesce("_now", F.lit(False))).select(*queue.columns, *["delivered"] * ("delivered" not in queue.columns))
    s = sessions.join(taken, key, "left").withColumn("exp_time", F.when(F.col("_n").isNotNull(), now + timeout).otherwise(F.col("exp_time")).cast("long")).select(*sessions.columns)
    left = quotas.join(taken, key, "left").withColumn("quota", F.col("quota") - F.coalesce("_n", F.lit(0))).where("quota > 0")
    return q, s, left.select(*quotas.columns)


def batches(delivered: DataFrame, partition: int = 0) -> DataFrame:
    """Delivered rows as one row a session, for a sink that pushes to workers."""
    one = F.struct("offset", "item", F.lit(partition).alias("partition"))
    return delivered.groupBy("worker", "session").agg(F.sort_array(F.collect_list(one)).alias("assignments"))
