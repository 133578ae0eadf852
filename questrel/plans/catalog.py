"""The catalog of queries over the driver's tables, each with the same query in DuckDB's SQL.

Roles: events is a log (event_id the offset, user_id the item or worker, ts the time), where 'view' queues a
task, 'click' and 'error' report on the user's last task, and 'signup' opens a session; orders are pointers
and results on items (o_custkey); suppliers are workers; nations are collections.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import admin, items, metrics, nassign, ratelimit, results, sessions, tokens
from ..operators.dedup import BitmapDedup, TableDedup, last_by_key, offset_gaps
from ..sources import logs
from ..sources.versions import ChangedTable, VersionedTable
from ..streaming import assigner, pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NOW = 1_704_672_000  # 2024-01-08, in the middle of the events
LATE = 1_706_572_800  # 2024-01-30, at their end
SECRET = bytes([3]) + bytes(31)
EPOCH = "epoch_us(ts) // 1000000"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))


def _pointers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("timestamp"))


def _queue(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("worker"), F.col("event_id").alias("offset"), F.concat(F.lit("item_"), F.col("event_id").cast("string")).alias("item"), (F.col("t") + 60).alias("exp_time"))


QUEUE_SQL = f"queue AS (SELECT user_id AS worker, event_id AS \"offset\", 'item_' || event_id AS item, {EPOCH} + 60 AS exp_time FROM events WHERE event_type = 'view')"


def _reports(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = _events(spark, sf_dir).withColumn("offset", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w))
    status = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return e.where("event_type in ('click', 'error') and offset is not null").select(F.col("user_id").alias("worker"), "offset", status.alias("status"), F.col("event_id").alias("seq"))


REPORTS_SQL = """reports AS (SELECT user_id AS worker, "offset", CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS status, event_id AS seq FROM
  (SELECT *, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "offset" FROM events)
  WHERE event_type IN ('click', 'error') AND "offset" IS NOT NULL)"""


def _sessions(spark, sf_dir):
    """A session for each signup, alive for a day."""
    e = _events(spark, sf_dir)
    s = sessions.open_sessions(e.where("event_type = 'signup'").select(F.col("user_id").alias("worker"), F.col("t").alias("time"), F.col("event_id").alias("seq")), timeout=86_400)
    return s


SESSIONS_SQL = f"sessions AS (SELECT user_id AS worker, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS session, {EPOCH} + 86400 AS exp_time FROM events WHERE event_type = 'signup')"


# ---- discovery and deduplication


@query("""
SELECT c AS item_id, arg_max(seq, (-batch) * 1000000000000 + seq) AS seq, max(-batch) * -1 AS batch FROM
  (SELECT o_custkey AS c, o_orderkey AS seq, o_orderkey // 256 AS batch FROM orders)
WHERE c NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) GROUP BY c
""")
def discover_new_items(spark, sf_dir):
    """The first micro-batch of 256 that brings an item, and its last pointer there, of items not known."""
    p = _pointers(spark, sf_dir).withColumn("batch", F.expr("seq div 256"))
    first = p.groupBy("item_id").agg(F.max_by(F.struct("seq", "batch"), F.struct(-F.col("batch"), F.col("seq"))).alias("r")).select("item_id", "r.*")
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"))
    return TableDedup(known).filter(first, "item_id", "seq")


@query("SELECT DISTINCT o_custkey AS item_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def dedup_anti_known(spark, sf_dir):
    return items.filter_new(_pointers(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id")))


@query("SELECT l_orderkey >> 10 AS bucket, count(DISTINCT l_orderkey & 1023) AS members FROM lineitem GROUP BY 1")
def dedup_bitmap(spark, sf_dir):
    state = BitmapDedup.empty(spark).add(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey").state
    return state.select("bucket", F.bitmap_count(F.col("bits")).alias("members"))


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)")
def dedup_bitmap_filter(spark, sf_dir):
    known = BitmapDedup.empty(spark).add(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")
    return known.filter(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")), "key")


@query("SELECT o_custkey AS item_id, max(o_orderkey) AS seq, arg_max(o_orderdate, o_orderkey) AS timestamp FROM orders GROUP BY 1")
def dedup_last_pointer(spark, sf_dir):
    return last_by_key(_pointers(spark, sf_dir), ["item_id"], "seq").select("item_id", "seq", "timestamp")


# ---- items


def _store(spark, sf_dir):
    half = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), half.alias("kind"))
    empty = spark.createDataFrame([], "item_id long, found_t timestamp_ntz, last_update timestamp_ntz, updates long")
    return items.insert_ignore(items.insert_ignore(empty, e.where("kind = 'signup'")), e.where("kind = 'view'"))


STORE_SQL = """store AS (SELECT user_id AS item_id, coalesce(arg_min(ts, event_id) FILTER (event_type = 'signup'), arg_min(ts, event_id) FILTER (event_type = 'view')) AS found_t
  FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1)"""


@query(f"WITH {STORE_SQL} SELECT item_id, found_t, 0::BIGINT AS updates FROM store")
def items_insert_ignore(spark, sf_dir):
    """Two batches of pointers, signups then views; what the first brought stays."""
    return _store(spark, sf_dir).select("item_id", "found_t", "updates")


@query("SELECT user_id AS item_id, arg_min(ts, event_id) AS found_t, arg_max(ts, event_id) AS last_update, count(*)::BIGINT AS updates FROM events GROUP BY 1")
def items_upsert_results(spark, sf_dir):
    empty = spark.createDataFrame([], "item_id long, found_t timestamp_ntz, last_update timestamp_ntz, updates long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("finish_time"), F.col("event_id").alias("seq"))
    return items.apply_results(empty, e)


@query("""
SELECT coalesce(o.k, e.k) AS item_id, coalesce(o.found_t, e.first_t) AS found_t, e.last_t AS last_update, coalesce(e.n, 0)::BIGINT AS updates
FROM (SELECT o_custkey AS k, arg_min(o_orderdate, o_orderkey) AS found_t FROM orders GROUP BY 1) o
FULL OUTER JOIN (SELECT user_id AS k, arg_min(ts, event_id) AS first_t, arg_max(ts, event_id) AS last_t, count(*) AS n FROM events GROUP BY 1) e ON o.k = e.k
""")
def items_lifecycle(spark, sf_dir):
    empty = spark.createDataFrame([], "item_id long, found_t timestamp_ntz, last_update timestamp_ntz, updates long")
    found = items.insert_ignore(empty, _pointers(spark, sf_dir))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("finish_time"), F.col("event_id").alias("seq"))
    return items.apply_results(found, e)


NATION_SQL = "nations AS (SELECT n_nationkey, n_nationkey AS position, 'yt.' || lower(n_name) AS name FROM nation)"


@query(f"""WITH {NATION_SQL} SELECT position, name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS item_count FROM nations UNION ALL SELECT 25, 'yt.none', 0""")
def collection_stats(spark, sf_dir):
    """A nation is a collection, with its customers as items; one more collection has no table."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.concat(F.lit("yt."), F.lower("n_name")).alias("name"))
    names = {r.position: r.name.replace(".", "_", 1) + "_items" for r in n.collect()}  # a topology is configuration, and small
    n = n.unionByName(spark.createDataFrame([(25, "yt.none")], n.schema))
    c = table(spark, sf_dir, "customer")
    return items.collection_stats(n, {t: c.where(F.col("c_nationkey") == i) for i, t in names.items()})


# ---- assignment


def _tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("collection"), F.lit(0).alias("partition"), F.col("o_orderkey").alias("offset"), F.col("o_custkey").cast("string").alias("item"))


def _workers(spark, sf_dir, quota: int):
    """Every supplier works for each of the three kinds of orders."""
    shard = F.explode(F.array(*[F.lit(x) for x in "FOP"])).alias("collection")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.lit(quota).cast("long").alias("quota"), F.lit(0).alias("partition"), shard)


def _even_sql(n: int) -> str:
    return f"""
WITH t AS (SELECT o_orderstatus AS collection, o_orderkey AS "offset", o_custkey::VARCHAR AS item, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS s FROM orders),
w AS (SELECT s_suppkey AS worker, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, count(*) OVER () AS w FROM supplier)
SELECT collection, 0 AS partition, worker, "offset", item, r::INTEGER AS replica FROM t CROSS JOIN range({n}) AS x(r) JOIN w ON (s * {n} + r) % w.w = place"""


PLENTY = 1 << 40


@query(_even_sql(1))
def nassign_n1(spark, sf_dir):
    return nassign.nassign(_tasks(spark, sf_dir), _workers(spark, sf_dir, PLENTY), 1)[0]


@query(_even_sql(2))
def nassign_n_divides_w(spark, sf_dir):
    return nassign.nassign_even(_tasks(spark, sf_dir), _workers(spark, sf_dir, PLENTY), 2)


@query(_even_sql(5))
def nassign_fold(spark, sf_dir):
    """The fold where the closed form would do as well."""
    return nassign.nassign(_tasks(spark, sf_dir), _workers(spark, sf_dir, PLENTY), 5, closed=False)[0]


@query("""
WITH RECURSIVE t AS (SELECT o_orderstatus AS collection, o_orderkey AS "offset", o_custkey::VARCHAR AS item, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS s FROM orders),
n AS (SELECT collection, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT collection, n, 0::BIGINT AS s, (SELECT list(s_suppkey ORDER BY s_suppkey) FROM supplier) AS line FROM n
  UNION ALL SELECT collection, n, s + 1, list_concat(line[4:], list_sort(line[1:3])) FROM r WHERE s + 1 < n)
SELECT collection, 0 AS partition, line[x + 1] AS worker, "offset", item, x::INTEGER AS replica FROM t JOIN r USING (collection, s) CROSS JOIN range(3) AS k(x)""")
def nassign_uneven(spark, sf_dir):
    """Three replicas for a number of workers that three doesn't divide: the first three of a line of workers, who go
    to its end in order of id."""
    return nassign.nassign(_tasks(spark, sf_dir), _workers(spark, sf_dir, PLENTY), 3)[0]


@query("""
WITH t AS (SELECT o_orderstatus AS collection, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS s, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders), q AS (SELECT count(*) * 7 AS q FROM supplier)
SELECT collection, 0 AS partition, CASE WHEN max(n) > max(q) THEN 'NO_WORKERS' ELSE 'OK' END AS code, max(CASE WHEN s <= q THEN o_orderkey END) AS progress, least(max(n), max(q))::BIGINT AS assigns FROM t, q GROUP BY 1""")
def nassign_quota(spark, sf_dir):
    """Seven tasks a worker: how far each shard comes."""
    return nassign.nassign(_tasks(spark, sf_dir), _workers(spark, sf_dir, 7), 1)[1]


@query(f"WITH a AS ({_even_sql(2)}) SELECT collection, worker, count(*) AS load FROM a GROUP BY 1, 2")
def nassign_load(spark, sf_dir):
    return nassign.nassign(_tasks(spark, sf_dir), _workers(spark, sf_dir, PLENTY), 2)[0].groupBy("collection", "worker").agg(F.count("*").alias("load"))


@query("""
SELECT event_type AS collection, 0 AS partition, count(*) AS stale FROM events JOIN (SELECT event_type AS e, max(event_id) AS p FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1) ON event_type = e AND event_id < p GROUP BY 1""")
def stale_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), "ts")
    done = e.where("ts < timestamp_ntz'2024-01-08'").groupBy("collection", "partition").agg(F.max("offset").alias("progress"))
    return nassign.stale(e, done).groupBy("collection", "partition").agg(F.count("*").alias("stale"))


@query("""SELECT count(*) AS falling FROM (SELECT l_orderkey, lag(l_orderkey) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS p FROM lineitem) WHERE l_orderkey <= p""")
def offset_monotone(spark, sf_dir):
    """Lines by date of shipping: how often the order's number doesn't rise."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("offset"), order.alias("seq"))
    return offset_gaps(d, ["l_returnflag"]).agg(F.count("*").alias("falling"))


# ---- sessions and quotas


@query(f"WITH {SESSIONS_SQL} SELECT worker, session, exp_time FROM sessions")
def session_serial(spark, sf_dir):
    return _sessions(spark, sf_dir)


@query(f"""SELECT user_id AS worker, event_id, (1 + sum(CASE WHEN t - p > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session
FROM (SELECT user_id, event_id, {EPOCH} AS t, lag({EPOCH}) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)""")
def session_ttl_split(spark, sf_dir):
    """A session ends where a user is silent for over five minutes."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, sf_dir).withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(w) > 300, F.lit(False))).cast("long"))
    return e.select(F.col("user_id").alias("worker"), "event_id", (1 + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("session"))


@query(f"WITH {SESSIONS_SQL} SELECT * FROM sessions WHERE exp_time < {NOW} ORDER BY exp_time, worker, session LIMIT 16")
def session_expire_batch(spark, sf_dir):
    """The operator's batch: the 16 sessions that expired first."""
    return sessions.expired_sessions(_sessions(spark, sf_dir), NOW, 16)


@query(f"WITH {SESSIONS_SQL}, {QUEUE_SQL} SELECT worker, \"offset\", item, 2 AS status, exp_time FROM queue WHERE worker NOT IN (SELECT worker FROM sessions WHERE exp_time >= {LATE})")
def dead_letter(spark, sf_dir):
    """Expired sessions close; workers that have none left lose their queues."""
    s = _sessions(spark, sf_dir)
    return sessions.dead_letter(_queue(spark, sf_dir), s.where(F.col("exp_time") >= LATE))


@query(f"""WITH {SESSIONS_SQL}, {QUEUE_SQL} SELECT worker, "offset", item, 2 AS status, exp_time FROM queue WHERE worker IN (SELECT worker FROM sessions) AND worker NOT IN (SELECT worker FROM sessions WHERE exp_time >= {LATE})""")
def session_expire_results(spark, sf_dir):
    return sessions.expire_sessions(_sessions(spark, sf_dir), _queue(spark, sf_dir), LATE, None)[2]


@query("""SELECT user_id AS worker, event_id AS seq, sum(CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS quota FROM events""")
def worker_quota_running(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    delta = F.when(F.col("event_type") == "signup", 5).when(F.col("event_type") == "view", -1).otherwise(0)
    return sessions.running_quota(e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), delta.alias("delta"))).select("worker", "seq", "quota")


GRANTS_SQL = f"""{SESSIONS_SQL}, grants AS (SELECT user_id AS worker, 1 + event_id % 7 AS session, (event_id % 5)::BIGINT AS n FROM events WHERE event_type = 'purchase')"""


def _granted(spark, sf_dir):
    g = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("worker"), (1 + F.col("event_id") % 7).alias("session"), (F.col("event_id") % 5).alias("n"))
    empty = spark.createDataFrame([], "worker long, session long, quota long")
    return sessions.grant(empty, g, _sessions(spark, sf_dir))


@query(f"WITH {GRANTS_SQL} SELECT worker, session, sum(n)::BIGINT AS total, sum(n)::BIGINT AS added FROM grants SEMI JOIN sessions USING (worker, session) WHERE n > 0 GROUP BY 1, 2")
def quota_grant(spark, sf_dir):
    return _granted(spark, sf_dir)[1]


@query(f"WITH {GRANTS_SQL} SELECT worker, count(*) AS rejected FROM grants g WHERE n <= 0 OR NOT EXISTS (SELECT 1 FROM sessions s WHERE s.worker = g.worker AND s.session = g.session) GROUP BY 1")
def quota_rejected(spark, sf_dir):
    return _granted(spark, sf_dir)[2].groupBy("worker").agg(F.count("*").alias("rejected"))


@query(f"""WITH {GRANTS_SQL}, q AS (SELECT worker, session, sum(n)::BIGINT AS quota FROM grants SEMI JOIN sessions USING (worker, session) WHERE n > 0 GROUP BY 1, 2)
SELECT worker, session, CASE WHEN session = 1 THEN 0 ELSE coalesce(quota, 0) END AS pending FROM sessions LEFT JOIN q USING (worker, session)""")
def quota_pending(spark, sf_dir):
    """Pending counts after each worker's first session surrendered."""
    s, quotas = _sessions(spark, sf_dir), _granted(spark, sf_dir)[0]
    left, _ = sessions.surrender(quotas, s.where("session = 1"))
    return sessions.pending(left, s)


@query(f"""WITH {GRANTS_SQL}, {QUEUE_SQL}, q AS (SELECT worker, session, least(sum(n), 1024) AS size FROM grants SEMI JOIN sessions USING (worker, session) WHERE n > 0 GROUP BY 1, 2),
r AS (SELECT *, sum(size) OVER (PARTITION BY worker ORDER BY session ROWS UNBOUNDED PRECEDING) AS upto FROM q), p AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY "offset") - 1 AS place FROM queue)
SELECT p.worker, session, "offset", item, exp_time FROM p JOIN r ON p.worker = r.worker AND place < upto AND place >= upto - size""")
def deliver_batch(spark, sf_dir):
    return sessions.deliver(_queue(spark, sf_dir), _granted(spark, sf_dir)[0])


DELIVERED_SQL = f"""{GRANTS_SQL}, {QUEUE_SQL}, q AS (SELECT worker, session, sum(n)::BIGINT AS quota, least(sum(n), 2) AS size FROM grants SEMI JOIN sessions USING (worker, session) WHERE n > 0 GROUP BY 1, 2),
r AS (SELECT *, sum(size) OVER (PARTITION BY worker ORDER BY session ROWS UNBOUNDED PRECEDING) AS upto FROM q), p AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY "offset") - 1 AS place FROM queue),
given AS (SELECT p.worker, session, "offset" FROM p JOIN r ON p.worker = r.worker AND place < upto AND place >= upto - size), taken AS (SELECT worker, session, count(*)::BIGINT AS n FROM given GROUP BY 1, 2)"""


def _delivered(spark, sf_dir):
    """What a delivery of two rows a session at most changes."""
    queue, quotas, s = _queue(spark, sf_dir), _granted(spark, sf_dir)[0], _sessions(spark, sf_dir)
    return sessions.commit_delivery(queue, s, quotas, sessions.deliver(queue, quotas, 2), NOW, 300)


@query(f'WITH {DELIVERED_SQL} SELECT worker, "offset", given.session IS NOT NULL AS delivered FROM queue LEFT JOIN given USING (worker, "offset")')
def deliver_marks(spark, sf_dir):
    return _delivered(spark, sf_dir)[0].select("worker", "offset", "delivered")


@query(f"WITH {DELIVERED_SQL} SELECT worker, session, CASE WHEN n IS NULL THEN exp_time ELSE {NOW + 300} END::BIGINT AS exp_time FROM sessions LEFT JOIN taken USING (worker, session)")
def deliver_extends(spark, sf_dir):
    return _delivered(spark, sf_dir)[1].select("worker", "session", "exp_time")


@query(f"WITH {DELIVERED_SQL} SELECT worker, session, quota - coalesce(n, 0) AS quota FROM q LEFT JOIN taken USING (worker, session) WHERE quota > coalesce(n, 0)")
def deliver_quota_left(spark, sf_dir):
    return _delivered(spark, sf_dir)[2]


# ---- results


ACK_SQL = f"""{QUEUE_SQL}, {REPORTS_SQL}, first AS (SELECT worker, "offset", arg_min(status, seq) AS status FROM reports GROUP BY 1, 2),
acked AS (SELECT worker, "offset", item, status, exp_time FROM queue JOIN first USING (worker, "offset")),
rest AS (SELECT * FROM queue ANTI JOIN first USING (worker, "offset"))"""


@query(f'WITH {ACK_SQL} SELECT worker, "offset", item, status, exp_time FROM acked')
def ack_results(spark, sf_dir):
    return results.ack(_queue(spark, sf_dir), _reports(spark, sf_dir))[1]


@query(f"WITH {ACK_SQL} SELECT worker, count(*) AS acknowledged FROM acked GROUP BY 1")
def ack_counts(spark, sf_dir):
    return results.ack(_queue(spark, sf_dir), _reports(spark, sf_dir))[2]


EXPIRED_SQL = f"""{ACK_SQL}, heads AS (SELECT worker, min("offset") AS head FROM rest WHERE exp_time >= {NOW} GROUP BY 1),
expired AS (SELECT worker, "offset", item, 2 AS status, exp_time FROM rest LEFT JOIN heads USING (worker) WHERE head IS NULL OR "offset" < head)"""


@query(f'WITH {EXPIRED_SQL} SELECT worker, "offset", item, status, exp_time FROM expired')
def task_expire(spark, sf_dir):
    return results.expire_tasks(results.ack(_queue(spark, sf_dir), _reports(spark, sf_dir))[0], NOW)[1]


def _all_results(spark, sf_dir):
    queue, acked, _ = results.ack(_queue(spark, sf_dir), _reports(spark, sf_dir))
    live, expired = results.expire_tasks(queue, NOW)
    dead = sessions.dead_letter(live, _sessions(spark, sf_dir).where(F.col("exp_time") >= LATE))
    return results.union_results(acked, expired, dead)


UNION_SQL = f"""{EXPIRED_SQL}, {SESSIONS_SQL}, live AS (SELECT * FROM rest ANTI JOIN expired USING (worker, "offset")),
every AS (SELECT worker, "offset", item, status, exp_time FROM acked UNION ALL SELECT worker, "offset", item, status, exp_time FROM expired
  UNION ALL SELECT worker, "offset", item, 2, exp_time FROM live WHERE worker NOT IN (SELECT worker FROM sessions WHERE exp_time >= {LATE}))"""


@query(f"WITH {UNION_SQL} SELECT worker, status, count(*) AS results FROM every GROUP BY 1, 2")
def results_union(spark, sf_dir):
    return _all_results(spark, sf_dir).groupBy("worker", "status").agg(F.count("*").alias("results"))


@query(f"WITH {UNION_SQL} SELECT 'yt.videos' AS collection, item AS id, worker AS worker_id, CASE status WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'CLIENT_FAILURE' WHEN 2 THEN 'TIMEOUT' END AS status, TIMESTAMP '2024-01-08' AS finish_time FROM every")
def forward_results(spark, sf_dir):
    d = results.forward(_all_results(spark, sf_dir), "yt.videos.results", F.lit("2024-01-08").cast("timestamp_ntz"))
    return d.select("locator.*", "worker_id", N.status_name("status").alias("status"), "finish_time")


# ---- metrics, rate, names


@query("""SELECT event_type AS collection, 0 AS partition, count(*) AS batches, sum(items)::BIGINT AS items, sum(new_items)::BIGINT AS new_items FROM
  (SELECT event_type, event_id // 256 AS b, count(*) AS items, count(*) FILTER (event_id = f) AS new_items FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type, user_id) AS f FROM events) GROUP BY 1, 2) GROUP BY 1""")
def microbatch_metrics(spark, sf_dir):
    first = F.min("event_id").over(Window.partitionBy("event_type", "user_id"))
    e = table(spark, sf_dir, "events").withColumn("f", first)
    b = e.groupBy(F.col("event_type").alias("collection"), F.lit(0).alias("partition"), F.expr("event_id div 256").alias("b")).agg(F.count("*").alias("items"), F.count_if(F.col("event_id") == F.col("f")).alias("new_items"))
    return metrics.discovery_metrics(b)


@query(f"""SELECT collection, 0 AS partition, count(*) AS batches, count(*) AS progress_batches, sum(a)::BIGINT AS assigns, max(o) AS "offset" FROM
  (SELECT o_orderstatus AS collection, o_orderkey // 1024 AS b, count(*) * 2 AS a, max(o_orderkey) AS o FROM orders GROUP BY 1, 2) GROUP BY 1""")
def assigner_metrics(spark, sf_dir):
    a = nassign.nassign(_tasks(spark, sf_dir), _workers(spark, sf_dir, PLENTY), 2)[0]
    b = a.groupBy("collection", "partition", F.expr("offset div 1024").alias("b")).agg(F.count("*").alias("assigns"), F.max("offset").alias("progress"))
    return metrics.assigner_metrics(b)


@query(f"""WITH c AS (SELECT user_id, event_id, {EPOCH} AS t, ({EPOCH}) // 86400 AS e, lag(({EPOCH}) // 86400) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
n AS (SELECT *, CASE WHEN p IS NULL OR e > p + 1 THEN 0 ELSE 1 END AS x FROM c),
w AS (SELECT *, sum(x) OVER (PARTITION BY user_id, e ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS w1 FROM n), s AS (SELECT user_id, e, sum(x) AS total FROM n GROUP BY 1, 2)
SELECT w.user_id, event_id, coalesce(total, 0)::BIGINT AS w0, w1::BIGINT AS w1, greatest((86400 - t % 86400) * coalesce(total, 0) + 86400 * w1 - 86400 * 2, 0)::BIGINT AS scaled_ban
FROM w LEFT JOIN s ON s.user_id = w.user_id AND s.e = w.e - 1""")
def rate_limit(spark, sf_dir):
    """Two events a day are allowed each user."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "t", F.lit(1).alias("x"))
    return ratelimit.rate_limit(e, "user_id", "t", "x", "event_id", 2, 86400).select("user_id", "event_id", F.col("w0").cast("long").alias("w0"), F.col("w1").cast("long").alias("w1"), "scaled_ban")


@query("""WITH c AS (SELECT event_type AS collection, count(DISTINCT event_id // 256) AS batches, count(*) AS results FROM events GROUP BY 1)
SELECT 'questrel_forward_batches{collection="' || collection || '",partition="0"} ' || batches AS line FROM c UNION ALL SELECT 'questrel_forward_results{collection="' || collection || '",partition="0"} ' || results FROM c""")
def metrics_exposition(spark, sf_dir):
    """What forwarders in batches of 256 offsets have counted, as text for a scraper."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("collection"), F.lit(0).alias("partition"), F.expr("event_id div 256").alias("b")).agg(F.count("*").alias("results"))
    return metrics.exposition(metrics.forward_metrics(e))


@query(f"WITH {SESSIONS_SQL} SELECT coalesce(min(exp_time), 0)::BIGINT AS next_expiry FROM sessions WHERE exp_time >= {NOW}")
def next_expiry(spark, sf_dir):
    return sessions.next_expiry(_sessions(spark, sf_dir).where(F.col("exp_time") >= NOW))


@query("""SELECT 'yt.videos.tasks' AS topic, 3 AS partition, x AS "offset", 'item_' || (x - 50) AS key, 'yt.videos' AS collection, 'item_' || (x - 50) AS id FROM range(50, 1050) AS r(x)""")
def synthetic_log(spark, sf_dir):
    """A thousand messages made up, written as a log, read as a stream and decoded."""
    path = _shared(spark)
    logs.append_log(logs.generate(spark, "yt.videos.tasks", 1000, first=50, partition=3), f"{path}/log")
    d = logs.decode(logs.stream_log(spark, f"{path}/log", 4), "collection string, id string")
    d = d.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), "collection", "id")
    d.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(d.schema).parquet(f"{path}/out")


@query(f"WITH {NATION_SQL} SELECT name, kind, name || '.' || kind AS topic FROM nations, (VALUES ('tasks'), ('discovered'), ('results')) AS k(kind)")
def topic_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("yt."), F.lower("n_name")).alias("name"))
    return n.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in N.KINDS]))).withColumn("topic", N.topic_name("name", F.col("kind")))


@query("SELECT url, regexp_extract(url, '(?s)^(.*)\\.[^.]*$', 1) AS collection FROM pages")
def collection_of_topic(spark, sf_dir):
    """What precedes the last dot of each URL."""
    return table(spark, sf_dir, "pages").select("url", N.collection_of_topic("url").alias("collection"))


@query("SELECT url, regexp_replace(url, '^([^.]*)\\.', '\\1_') || '_items' AS table_name FROM pages")
def table_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", N.table_name("url").alias("table_name"))


@query("SELECT source || '.discovered' AS topic, count(*) AS pointers FROM documents GROUP BY 1")
def route_by_collection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.struct(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("id")).alias("dst"), F.timestamp_seconds(F.col("doc_id")).alias("timestamp"))
    return results.route_discovered(d).groupBy("topic").agg(F.count("*").alias("pointers"))


@query("""SELECT event_id, lower(lpad(printf('%X', event_id), 16, '0')) AS packed, lower(lpad(printf('%X', user_id), 16, '0') || lpad(printf('%X', event_id), 16, '0')) AS session_key, event_id AS unpacked,
  event_id AS entry_offset, rtrim(to_base64(event_type::BLOB), '=') AS b64, event_type AS decoded, event_type AS token FROM events""")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    packed = N.big_endian("event_id")
    return e.select(
        "event_id",
        F.lower(F.hex(packed)).alias("packed"),
        F.lower(F.hex(N.session_key("user_id", "event_id"))).alias("session_key"),
        N.from_big_endian(packed).alias("unpacked"),
        N.queue_entry_offset(F.concat(F.col("event_id").cast("string"), F.lit("-1"))).alias("entry_offset"),
        N.base64_std(F.col("event_type").cast("binary")).alias("b64"),
        N.from_base64_url(N.base64_url(F.col("event_type").cast("binary"))).cast("string").alias("decoded"),
        N.bearer_token(F.concat(F.lit("Bearer "), F.col("event_type"))).alias("token"),
    )


# ---- tokens and caches


def _tokens(spark, sf_dir):
    """A token for each supplier: its id is the MD5 of the name."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.unhex(F.md5(F.col("s_name").cast("binary"))).alias("id"), F.col("s_suppkey").alias("worker_id"), F.lit("H").alias("description"))


@query("""WITH texts AS (SELECT url AS text FROM pages UNION ALL
  SELECT 'H' || replace(replace(rtrim(to_base64(unhex('0b' || md5(s_name) || md5(s_name))), '='), '+', '-'), '/', '_') FROM supplier UNION ALL
  SELECT 'H' || replace(replace(rtrim(to_base64(unhex('0c' || md5(s_name) || md5(s_name))), '='), '+', '-'), '/', '_') FROM supplier)
SELECT text, CASE WHEN length(text) <> 45 THEN 'length' WHEN NOT starts_with(text, 'H') THEN 'prefix' WHEN NOT regexp_full_match(text, '[A-Za-z0-9_-]*') THEN 'alphabet' ELSE 'form' END AS verdict,
  text IN (SELECT 'H' || replace(replace(rtrim(to_base64(unhex('0b' || md5(s_name) || md5(s_name))), '='), '+', '-'), '/', '_') FROM supplier) AS valid FROM texts""")
def token_verify_structure(spark, sf_dir):
    """URLs taken for tokens, with what is wrong first; and texts of the right form, half of them of another first byte."""
    name = F.md5(F.col("s_name").cast("binary"))
    made = [table(spark, sf_dir, "supplier").select(tokens.marshal(F.unhex(F.concat(F.lit(b), name, name))).alias("text")) for b in ("0b", "0c")]
    t = F.col("text")
    verdict = F.when(F.length(t) != tokens.TEXT_SIZE, "length").when(~t.startswith("H"), "prefix").when(~t.rlike(r"\A[A-Za-z0-9_-]*\z"), "alphabet").otherwise("form")
    d = table(spark, sf_dir, "pages").select(F.col("url").alias("text")).unionByName(made[0]).unionByName(made[1])
    return d.select("text", verdict.alias("verdict"), tokens.unmarshal("text").isNotNull().alias("valid"))


@query()
def token_mac(spark, sf_dir):
    """Signed tokens as text; keyed BLAKE2b is beyond SQL, so tests hold it against fixed vectors."""
    d = _tokens(spark, sf_dir)
    return d.select("worker_id", tokens.marshal(tokens.serialize(tokens.sign("id", SECRET), F.col("id"))).alias("token"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'corrupt' WHEN c_mktsegment = 'MACHINERY' THEN 'bad_mac' WHEN c_nationkey < 5 THEN 'unknown' ELSE 'ok' END AS verdict,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey >= 5 THEN s_suppkey END AS worker_id FROM customer JOIN (SELECT s_suppkey, count(*) OVER () AS n FROM supplier) ON c_custkey % n = s_suppkey""")
def token_auth_ladder(spark, sf_dir):
    """Customers come with suppliers' tokens: some cut, some with another tag, some of ids not stored."""
    t = _tokens(spark, sf_dir)
    c = table(spark, sf_dir, "customer").join(F.broadcast(t.agg(F.count("*").alias("n")))).withColumn("worker", F.col("c_custkey") % F.col("n")).drop("n")  # one row
    c = c.join(t.select(F.col("id").alias("tid"), F.col("worker_id").alias("worker")), "worker")
    tid = F.when(F.col("c_nationkey") < 5, F.unhex(F.md5(F.concat(F.lit("no"), F.col("c_name")).cast("binary")))).otherwise(F.col("tid"))
    c = c.withColumn("tid", tid).withColumn("tag", tokens.sign("tid", SECRET))
    tag = F.when(F.col("c_mktsegment") == "MACHINERY", F.reverse(F.hex("tag"))).otherwise(F.hex("tag"))
    text = tokens.marshal(tokens.serialize(F.unhex(tag), F.col("tid")))
    text = F.when(F.col("c_mktsegment") == "BUILDING", F.substring(text, 1, 44)).otherwise(text)
    return tokens.authenticate(c.withColumn("authorization", F.concat(F.lit("Bearer "), text)).drop("worker"), t, SECRET).select("c_custkey", "verdict", "worker_id")


@query("SELECT s_suppkey AS worker_id, md5(s_name) AS id FROM supplier WHERE s_suppkey <> 3")
def tokens_revoke(spark, sf_dir):
    left, _ = tokens.revoke_all(_tokens(spark, sf_dir), 3)
    return left.select("worker_id", F.lower(F.hex("id")).alias("id"))


@query("SELECT s_suppkey AS worker, CASE WHEN s_suppkey % 3 = 0 THEN 'invalid' ELSE 'ok' END AS verdict, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS worker_id FROM supplier")
def token_invalid(spark, sf_dir):
    """Every third supplier's token is stored, but marked as no longer valid."""
    t = _tokens(spark, sf_dir).withColumn("valid", F.col("worker_id") % 3 != 0)
    text = tokens.marshal(tokens.serialize(tokens.sign("id", SECRET), F.col("id")))
    r = _tokens(spark, sf_dir).select(F.col("worker_id").alias("worker"), F.concat(F.lit("Bearer "), text).alias("authorization"))
    return tokens.authenticate(r, t, SECRET).select("worker", "verdict", "worker_id")


@query("""SELECT n AS name, s_suppkey AS worker_id, s_suppkey IS NOT NULL AS valid FROM (SELECT s_name AS n FROM supplier UNION ALL SELECT c_name FROM customer) LEFT JOIN supplier ON n = s_name""")
def token_lookup(spark, sf_dir):
    """Ids of suppliers, which are stored, and of customers, which are not."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))
    ids = names.withColumn("id", F.unhex(F.md5(F.col("name").cast("binary"))))
    return tokens.lookup(_tokens(spark, sf_dir), ids).select("name", "worker_id", "valid")


@query("""SELECT rtrim(to_base64(unhex(md5(c_name))), '=') AS id, c_mktsegment AS description, right(c_name, 4) AS token_bit FROM customer WHERE c_nationkey = 3""")
def tokens_listed(spark, sf_dir):
    """Customers' tokens belong to their nation: those of one, with ids as text."""
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("timestamp")
    t = c.select(F.unhex(F.md5(F.col("c_name").cast("binary"))).alias("id"), F.col("c_nationkey").cast("long").alias("worker_id"), none.alias("created_at"), none.alias("last_used_at"), F.expr("right(c_name, 4)").alias("token_bit"), F.col("c_mktsegment").alias("description"))
    return tokens.listed(t, 3).select("id", "description", "token_bit")


@query("""SELECT md5(s_name) AS id, s_suppkey AS worker_id, 'H' AS description FROM supplier UNION ALL SELECT '000102030405060708090a0b0c0d0e0f', 7, 'new'""")
def tokens_created(spark, sf_dir):
    """Suppliers' tokens and a new one of a given id."""
    t = _tokens(spark, sf_dir).select("id", "worker_id", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_used_at"), F.lit("").alias("token_bit"), "description")
    more, _ = tokens.create(t, 7, "new", SECRET, None, bytes(range(16)))
    return more.select(F.lower(F.hex("id")).alias("id"), "worker_id", "description")


@query("SELECT user_id AS id, event_id AS seq FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 64")
def invalidation_log(spark, sf_dir):
    """A log of 64 invalidations, to which the latter half of January is added."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "ts")
    old, new = (e.where(f"ts {x} timestamp_ntz'2024-01-16'").drop("ts") for x in ("<", ">="))
    return tokens.add_invalidation(old, new, 64)


@query("SELECT user_id AS id, max(event_id) AS event_id FROM events GROUP BY 1 HAVING max(epoch_us(ts) // 1000000) >= 1706486400 - 86400 ORDER BY max(epoch_us(ts) // 1000000) DESC, id LIMIT 64")
def cache_ttl_lru(spark, sf_dir):
    """What a cache of 64 users holds that keeps them a day."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("id"), "event_id", "t")
    return tokens.cached(e, "id", "t", 86400, 64, 1_706_486_400).select("id", "event_id")


@query("""SELECT event_type, user_id, max(epoch_us(ts) // 1000000) AS t FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY max(epoch_us(ts) // 1000000) DESC, user_id) <= 16""")
def cache_by_shard(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", "user_id", "t")
    return tokens.cached_by(e, "event_type", "user_id", "t", 10**9, 16, 1_706_486_400)


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-28')")
def cache_invalidate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    return tokens.apply_invalidations(e.where("event_type = 'signup'").select("id").distinct(), e.where("event_type = 'error' and ts >= timestamp_ntz'2024-01-28'"))


# ---- dumps


@query("SELECT event_id AS \"offset\", user_id::VARCHAR AS key FROM events")
def log_dump(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("offset"), F.col("user_id").cast("string").cast("binary").alias("key"))
    return admin.dump_log(e).select(F.from_json("line", "offset long, key string").alias("x")).select("x.*")


@query(f"""WITH {SESSIONS_SQL} SELECT 'session_count' AS section, worker::VARCHAR AS key, count(*)::BIGINT AS n FROM sessions GROUP BY 2 UNION ALL SELECT 'session_serial', worker::VARCHAR, max(session)::BIGINT FROM sessions GROUP BY worker""")
def state_dump_json(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    d = admin.dump_state(session_count=sessions.session_counts(s).select("worker", F.col("sessions").alias("n")), session_serial=s.groupBy("worker").agg(F.max("session").alias("n")))
    return d.select("section", "key", F.get_json_object("value", "$.n").cast("long").alias("n"))


# ---- streams: the driver's table as a stream, run until all is read


def _shared(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"file://{tempfile.gettempdir()}/questrel"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if spark.read.parquet(path).inputFiles()[0].rstrip("/").rpartition("/")[0].endswith(".parquet") else f"{sf_dir}/{name}.parque[t]")


@query("SELECT o_custkey::VARCHAR AS id, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def stream_discover(spark, sf_dir):
    """All orders in one micro-batch: the tasks of new items come with their last pointers."""
    path = _shared(spark)
    schema = "item_id string, found_t timestamp, last_update timestamp, updates long"
    store, tasks = ChangedTable(spark, f"{path}/items", schema, items.merged), VersionedTable(spark, f"{path}/tasks", "topic string, key binary, value binary")
    p = _stream(spark, sf_dir, "orders").select(F.struct(F.col("o_orderstatus").alias("collection"), F.col("o_custkey").cast("string").alias("id")).alias("dst"), F.timestamp_seconds(F.col("o_orderkey")).alias("timestamp"), F.col("o_orderkey").alias("seq"))
    pipelines.discovery(p, store, tasks, "orders", f"{path}/checkpoint").awaitTermination()
    return tasks.read().select(F.col("key").cast("string").alias("id")).join(store.read().select(F.col("item_id").alias("id"), F.unix_timestamp("found_t").alias("seq")), "id")


@query("SELECT user_id::VARCHAR AS item_id, count(*)::BIGINT AS updates, arg_max(ts, event_id) AS last_update FROM events GROUP BY 1")
def stream_results(spark, sf_dir):
    path = _shared(spark)
    store = ChangedTable(spark, f"{path}/items", "item_id string, found_t timestamp, last_update timestamp, updates long", items.merged)
    r = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("finish_time"), F.col("event_id").alias("seq"))
    pipelines.reporter(r, store, f"{path}/checkpoint").awaitTermination()
    return store.read().select("item_id", "updates", F.col("last_update").cast("timestamp_ntz").alias("last_update"))


@query("SELECT 'yt.videos' AS collection, user_id::VARCHAR AS id, event_id % 10 AS worker_id, (event_id % 3)::INTEGER AS status FROM events")
def stream_forward(spark, sf_dir):
    """Results of a stream leave projected, in one micro-batch."""
    path = _shared(spark)
    out = VersionedTable(spark, f"{path}/out", "locator struct<collection:string,id:string>, finish_time timestamp, worker_id long, status int")
    r = _stream(spark, sf_dir, "events").select((F.col("event_id") % 10).alias("worker"), F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("item"), (F.col("event_id") % 3).cast("int").alias("status"), F.lit(0).cast("long").alias("exp_time"))
    pipelines.forwarder(r, out, "yt.videos.results", F.timestamp_seconds(F.lit(NOW)), f"{path}/checkpoint").awaitTermination()
    return out.read().select("locator.*", "worker_id", "status")


@query("""
WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS s FROM events)
SELECT 'events' AS collection, 0 AS partition, (s * 2 + r) % 10 AS worker, event_id AS "offset", event_id::VARCHAR AS item, r::INTEGER AS replica FROM t, range(2) AS x(r)""")
def stream_nassign(spark, sf_dir):
    """Ten workers with ample quota take each event twice, in a stateful stream."""
    path = _shared(spark)
    grants = spark.range(10).select(F.lit("events").alias("collection"), F.lit(0).alias("partition"), (F.col("id") - 10).alias("seq"), F.lit("grant").alias("kind"), F.col("id").alias("worker"), F.lit(PLENTY).alias("n"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("item"))
    tasks = table(spark, sf_dir, "events").select(F.lit("events").alias("collection"), F.lit(0).alias("partition"), F.col("event_id").alias("seq"), F.lit("task").alias("kind"), F.lit(None).cast("long").alias("worker"), F.lit(None).cast("long").alias("n"), F.col("event_id").alias("offset"), F.col("event_id").cast("string").alias("item"))
    grants.unionByName(tasks).write.parquet(f"{path}/in")
    out = assigner.assigner(spark.readStream.schema(assigner.EVENTS).parquet(f"{path}/in"), 2)
    sink = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    sink.start().awaitTermination()
    return spark.read.schema(assigner.OUT).parquet(f"{path}/out")
