"""A shard's turn from grants to results: the operators joined, with the limits of its collection's configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CollectionConfig
from ..operators import nassign, results, sessions


@dataclass(frozen=True)
class Shard:
    """The tables of one partition of a collection. Steps return the shard after them and what they give out; none
    reads a table on the driver.

    A worker may be given as much as its sessions' quotas hold beyond what waits for it undelivered, so a session
    takes its quota along when it ends. Steps only plan: between turns, a caller writes the tables by kept().
    """

    config: CollectionConfig
    partition: int
    sessions: DataFrame  # worker, session, exp_time
    serials: DataFrame  # worker, serial: the sessions that a worker has ever had
    quotas: DataFrame  # worker, session, quota
    queue: DataFrame  # worker, offset, item, exp_time, delivered
    last: DataFrame  # worker, last_offset
    placed: DataFrame  # offset, placed: replicas of offsets that aren't placed in full
    progress: DataFrame  # progress: one row at most, the last offset placed in full

    @classmethod
    def empty(cls, spark: SparkSession, config: CollectionConfig, partition: int = 0) -> Shard:
        kinds = {
            "sessions": "worker long, session long, exp_time long",
            "serials": "worker long, serial long",
            "quotas": "worker long, session long, quota long",
            "queue": "worker long, offset long, item string, exp_time long, delivered boolean",
            "last": "worker long, last_offset long",
            "placed": "offset long, placed long",
            "progress": "progress long",
        }
        return cls(config, partition, **{k: spark.createDataFrame([], v) for k, v in kinds.items()})

    def kept(self, keep: Callable[[DataFrame, str], DataFrame]) -> Shard:
        """The shard with each table as keep(table, name) returns it, such as written and read again."""
        return replace(self, **{f.name: keep(getattr(self, f.name), f.name) for f in fields(self) if f.name not in ("config", "partition")})

    def open(self, requests: DataFrame) -> tuple[Shard, DataFrame]:
        """requests: worker, time, seq. Gives the new sessions."""
        new = sessions.open_sessions(requests, self.serials, int(self.config.session_timeout.total_seconds()))
        serials = self.serials.unionByName(new.select("worker", F.col("session").alias("serial"))).groupBy("worker").agg(F.max("serial").alias("serial"))
        return replace(self, sessions=self.sessions.unionByName(new), serials=serials), new

    def grant(self, grants: DataFrame) -> tuple[Shard, DataFrame, DataFrame]:
        """grants: worker, session, n. Gives what was granted and what was rejected."""
        quotas, granted, rejected = sessions.grant(self.quotas, grants, self.sessions)
        return replace(self, quotas=quotas), granted, rejected

    def workers(self) -> DataFrame:
        """Who may be given tasks: worker, quota (above 0), last_offset (-1 for none)."""
        waiting = self.queue.where("not delivered").groupBy("worker").agg(F.count("*").alias("_waiting"))
        d = sessions.worker_quotas(self.quotas).join(waiting, "worker", "left").withColumn("quota", F.col("quota") - F.coalesce("_waiting", F.lit(0)))
        return d.where("quota > 0").join(self.last, "worker", "left").select("worker", "quota", F.coalesce("last_offset", F.lit(-1)).alias("last_offset"))

    def assign(self, tasks: DataFrame, now: int) -> tuple[Shard, DataFrame]:
        """tasks: offset, item; the first assign_batch of those behind the progress. Gives the status row of
        nassign(), with the progress before where nothing was placed in full."""
        shard = (F.lit(self.config.name).alias("collection"), F.lit(self.partition).alias("partition"))
        before = self.progress.agg(F.max("progress").alias("_before"))  # one row, whatever there is
        ahead = tasks.join(F.broadcast(before), F.col("offset") > F.coalesce("_before", F.lit(-1))).drop("_before")
        ahead = ahead.orderBy("offset").limit(self.config.assign_batch).join(self.placed, "offset", "left")
        n = self.config.task_assignments
        found, status = nassign.nassign(ahead.select(*shard, "*"), self.workers().select(*shard, "*"), n, closed=False)
        rows = found.select("worker", "offset", "item", F.lit(now + int(self.config.task_timeout.total_seconds())).cast("long").alias("exp_time"), F.lit(False).alias("delivered"))
        last = self.last.unionByName(found.select("worker", F.col("offset").alias("last_offset"))).groupBy("worker").agg(F.max("last_offset").alias("last_offset"))
        counts = self.placed.unionByName(found.groupBy("offset").agg(F.count("*").alias("placed"))).groupBy("offset").agg(F.sum("placed").alias("placed"))
        reached = self.progress.unionByName(status.select("progress")).agg(F.max("progress").alias("progress")).where("progress is not null")
        after = replace(self, queue=self.queue.unionByName(rows), last=last, placed=counts.where(F.col("placed") < n), progress=reached)
        return after, status.join(F.broadcast(before)).withColumn("progress", F.coalesce("progress", "_before")).drop("_before")

    def deliver(self, asked: DataFrame, now: int) -> tuple[Shard, DataFrame, DataFrame]:
        """asked: worker, session. Gives the rows delivered, deliver_batch a session at most, and the sessions asked
        for that aren't open."""
        key = ["worker", "session"]
        asked, live = asked.select(*key).distinct(), self.sessions.select(*key)
        known, unknown = asked.join(live, key, "left_semi"), asked.join(live, key, "left_anti")
        given = sessions.deliver(self.queue, self.quotas.join(known, key, "left_semi"), self.config.deliver_batch)
        queue, live, quotas = sessions.commit_delivery(self.queue, self.sessions, self.quotas, given, now, int(self.config.session_timeout.total_seconds()))
        return replace(self, queue=queue, sessions=live, quotas=quotas), given, unknown

    def ack(self, reports: DataFrame) -> tuple[Shard, DataFrame]:
        """reports: worker, offset, status, seq. Gives the results."""
        queue, done, _ = results.ack(self.queue, reports)
        return replace(self, queue=queue.select(*self.queue.columns)), done

    def close(self, closing: DataFrame) -> tuple[Shard, DataFrame]:
        """closing: worker, session. Gives the results of workers that lost their last session."""
        live, queue, dead, quotas = sessions.close_sessions(self.sessions, closing, self.queue, self.quotas)
        return replace(self, sessions=live, queue=queue.select(*self.queue.columns), quotas=quotas.select(*self.quotas.columns)), dead

    def expire(self, now: int) -> tuple[Shard, DataFrame]:
        """Gives the results of tasks whose time is over, then those of workers whose sessions are, of which the
        earliest session_expire_batch end."""
        queue, late = results.expire_tasks(self.queue, now)
        rest, dead = replace(self, queue=queue).close(sessions.expired_sessions(self.sessions, now, self.config.session_expire_batch))
        return rest, results.union_results(late, dead)
