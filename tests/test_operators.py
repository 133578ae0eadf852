import random

import pytest
from pyspark.sql import functions as F

from questrel.functions import naming as N
from questrel.model import CollectionConfig
from questrel.operators import admin, items, metrics, nassign, ratelimit, results, sessions, tokens
from questrel.operators.dedup import BitmapDedup, TableDedup
from questrel.plans.loop import Shard

ITEMS = "item_id long, found_t long, last_update long, updates long"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_item_store(spark):
    def pointers(*p):
        return spark.createDataFrame([(str(i), t, n) for n, (i, t) in enumerate(p)], "item_id string, timestamp long, seq long")

    store = items.insert_ignore(spark.createDataFrame([], ITEMS), pointers((1, 3), (2, 3)))
    store = items.insert_ignore(store, pointers((2, 5), (3, 10)))
    assert rows(store, "item_id") == [(1, 3, None, 0), (2, 3, None, 0), (3, 10, None, 0)]
    done = spark.createDataFrame([("2", 3, 0), ("2", 4, 1), ("3", 4, 2), ("4", 23, 3)], "item_id string, finish_time long, seq long")
    assert rows(items.apply_results(store, done), "item_id") == [(1, 3, None, 0), (2, 3, 4, 2), (3, 10, 4, 1), (4, 23, 23, 1)]
    assert rows(items.filter_new(pointers((1, 0), (9, 0), (9, 1)), store)) == [(9,)]


def test_keys_meet_as_numbers(spark):
    known = spark.createDataFrame([(7,)], "item_id long")
    batch = spark.createDataFrame([("007", 1), ("8", 2), ("08", 3)], "id string, seq long")
    assert rows(TableDedup(known).filter(batch, "id", "seq")) == [(8, 3)]


def test_bitmap(spark):
    def batch(*keys):
        return spark.createDataFrame([(k,) for k in keys], "k string")

    empty = BitmapDedup.empty(spark)
    assert rows(empty.add(batch(), "k").filter(batch(), "k")) == []
    with pytest.raises(Exception, match='item is not a number: "a"'):
        empty.add(batch("1", "3000", "1023", "a"), "k").state.collect()
    s = empty.add(batch("1", "3000", "1023"), "k")
    state = {r.bucket: bytes(r.bits) for r in s.state.collect()}
    assert set(state) == {0, 2} and len(state[0]) == 128
    assert state[0][0] == 0x40 and state[0][127] == 0x01 and state[2][119] == 0x80 and sum(map(sum, state.values())) == 0x40 + 0x01 + 0x80
    with pytest.raises(Exception, match="item is not a number"):
        s.filter(batch("2999", "d", "3"), "k").collect()
    assert [r.k for r in s.filter(batch("2999", "2999", "3", "3000", "1"), "k").collect()] == ["3", "2999"]
    again = s.add(batch("1", "3000", "1023"), "k")
    assert {r.bucket: bytes(r.bits) for r in again.state.collect()} == state
    more = {r.bucket: bytes(r.bits) for r in s.add(batch("2", "1016", "5000", "00000000000000000003"), "k").state.collect()}
    assert (more[0][0], more[0][127], more[2], len(more[4])) == (0x70, 0x81, state[2], 128)


def fold(spark, tasks, workers, n, compat="intended"):
    t = spark.createDataFrame([("c", 0, o, str(o)) for o in tasks], "collection string, partition int, offset long, item string")
    w = spark.createDataFrame([("c", 0, *x) for x in workers], "collection string, partition int, worker long, quota long, last_offset long")
    a, s = nassign.nassign(t, w, n, compat)
    return [(r.offset, r.worker) for r in a.orderBy("offset", "replica").collect()], [tuple(r)[2:] for r in s.collect()]


def test_assignment_fixture(spark):
    placed, status = fold(spark, range(128, 144), [(1, 5, -1)], 1)
    assert placed == [(o, 1) for o in range(128, 133)] and status == [("NO_WORKERS", 132, 5)]


def test_assignment_of_three_among_seven(spark):
    placed, status = fold(spark, range(1, 701), [(w, 10**6, -1) for w in range(7)], 3)
    assert [w for o, w in placed if o <= 3] == [0, 1, 2, 3, 4, 5, 6, 0, 1]
    load = [sum(w == x for _, w in placed) for x in range(7)]
    assert load == [350, 350, 350, 350, 234, 233, 233] and len(set(placed)) == 2100 and status == [("OK", 700, 2100)]


def test_too_few_workers(spark):
    assert fold(spark, [5, 6], [(1, 9, -1), (2, 9, -1)], 3) == ([(5, 1), (5, 2)], [("NO_WORKERS", None, 2)])
    assert fold(spark, [5, 6], [], 3) == ([], [("NO_WORKERS", None, 0)])


def test_resumed_offset():
    def run(compat):
        s = nassign.ShardState()
        for w in (1, 2):
            s.grant(w, 10)
        out = list(nassign.assign(s, iter([(10, "x")]), 3, compat))
        for w in (3, 4):
            s.grant(w, 10)
        return [r[0] for r in out + list(nassign.assign(s, iter([(10, "x")]), 3, compat))]

    assert run("intended") == [1, 2, 3] and run("as_written") == [1, 2, 3, 4]


def plain_fold(tasks, quota, last, n):
    out, progress = [], None
    for o in tasks:
        for _ in range(n):
            ready = [(last[w], w) for w in quota if quota[w] > 0]
            if not ready or min(ready)[0] >= o:
                return out, progress
            w = min(ready)[1]
            last[w], quota[w] = o, quota[w] - 1
            out.append((o, w))
        progress = o
    return out, progress


def test_fold_against_a_plain_one(spark):
    rng = random.Random(5)
    for _ in range(6):
        tasks = sorted(rng.sample(range(500), rng.randint(0, 60)))
        workers = [(w, rng.randint(1, 40), rng.choice([-1, rng.randint(0, 100)])) for w in rng.sample(range(50), rng.randint(0, 9))]
        n = rng.randint(1, 4)
        placed, status = fold(spark, tasks, workers, n)
        want, progress = plain_fold(tasks, {w: q for w, q, _ in workers}, {w: x for w, _, x in workers}, n)
        assert placed == want
        if tasks or workers:
            assert status[0][1:] == (progress, len(want))


def test_closed_form_against_the_fold(spark, monkeypatch):
    """Shards of every kind at once: those that the closed form takes, and those that lack one of its conditions."""
    monkeypatch.setattr(nassign, "RANGE", 8)
    rng = random.Random(9)
    tasks, workers = [], []
    for shard in range(24):
        n_workers, quota, last = rng.choice([2, 3, 4, 6, 0]), rng.choice([3, 40, 1 << 40]), rng.choice([-1, -1, 7])
        offsets = sorted(rng.sample(range(rng.choice([0, 8]), 400), rng.choice([0, 1, 30, 60])))
        tasks += [("c", shard, o, str(o), 1 if shard == 3 and o == offsets[0] else None) for o in offsets]
        workers += [("c", shard, w, quota, last + (shard % 5 == 0 and w == 1)) for w in rng.sample(range(50), n_workers)]
    tasks += [(None, 0, 5, "x", None), ("d", None, 5, "x", None)]
    t = spark.createDataFrame(tasks, "collection string, partition int, offset long, item string, placed long")
    w = spark.createDataFrame(workers, "collection string, partition int, worker long, quota long, last_offset long")
    for n in (1, 2, 3):
        plain, closed = nassign.nassign(t, w, n, closed=False), nassign.nassign(t, w, n)
        for a, b in zip(plain, closed, strict=True):
            assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        monkeypatch.setattr(nassign, "_folded", lambda t, w, n, compat, real=nassign._folded: real(t.limit(0), w.limit(0), n, compat))
        closed = set()
        for shard in range(24):
            at, of = [x for x in tasks if x[:2] == ("c", shard)], [x for x in workers if x[1] == shard]
            if at and of and not len(of) % n and len({x[4] for x in of}) == 1 and of[0][4] < at[0][2] and shard != 3 and -(-len(at) * n // len(of)) <= of[0][3]:
                closed.add(shard)
        assert closed and {r.partition for r in nassign.nassign(t, w, n)[1].collect()} == closed
        monkeypatch.undo()
        monkeypatch.setattr(nassign, "RANGE", 8)


def test_falling_offsets(spark):
    t = spark.createDataFrame([("c", 0, 5, "a"), ("c", 0, 5, "b")], "collection string, partition int, offset long, item string")
    w = spark.createDataFrame([("c", 0, 1, 5)], "collection string, partition int, worker long, quota long")
    with pytest.raises(Exception, match="offsets must rise"):
        nassign.nassign(t, w, 1)[0].collect()
    log = t.withColumn("seq", F.col("item"))
    with pytest.raises(Exception, match="offsets must rise"):
        nassign.checked_offsets(log).collect()


def test_sessions(spark):
    asked = spark.createDataFrame([(1, 100, 1), (1, 110, 2), (2, 120, 3)], "worker long, time long, seq long")
    s = sessions.open_sessions(asked, spark.createDataFrame([(2, 4)], "worker long, serial long"))
    assert rows(s, "worker", "session") == [(1, 1, 400), (1, 2, 410), (2, 5, 420)]
    assert rows(sessions.expired_sessions(s, 410)) == [(1, 1, 400)] and sessions.next_expiry(s).first()[0] == 400
    assert sessions.next_expiry(s.where("false")).first()[0] == 0
    assert [sessions.watchdog_sleep(*x) for x in ((0, 5), (7, 5), (500, 5), (3, 5))] == [300, 2, 10, 0]
    queue = spark.createDataFrame([(1, 7, "a", 50), (2, 8, "b", 60)], "worker long, offset long, item string, exp_time long")
    left, q, dead, _ = sessions.close_sessions(s, spark.createDataFrame([(1, 1), (2, 5), (9, 9)], "worker long, session long"), queue)
    assert rows(left) == [(1, 2, 410)] and rows(q) == [(1, 7, "a", 50)] and rows(dead) == [(2, 8, "b", 2, 60)]


def test_quotas(spark):
    s = spark.createDataFrame([(1, 1)], "worker long, session long")
    empty = spark.createDataFrame([], "worker long, session long, quota long")
    g = spark.createDataFrame([(1, 1, 5), (1, 1, 2), (1, 2, 5), (1, 1, 0)], "worker long, session long, n long")
    q, granted, bad = sessions.grant(empty, g, s)
    assert rows(granted) == [(1, 1, 7, 7)] and sorted(rows(bad)) == [(1, 1, 0), (1, 2, 5)]
    asked = spark.createDataFrame([(1, 1), (9999, 1)], "worker long, session long")
    assert rows(sessions.pending(q, asked), "worker") == [(1, 1, 7), (9999, 1, 0)]
    q, removed = sessions.surrender(q, asked)
    assert rows(q) == [(1, 1, 0)] and rows(removed) == [(1, 1, 7)]


def test_delivery_changes_state(spark):
    queue = spark.createDataFrame([(1, i, f"item_{i}", 1000, i == 3) for i in range(3, 9)], "worker long, offset long, item string, exp_time long, delivered boolean")
    s = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 70)], "worker long, session long, exp_time long")
    quotas = spark.createDataFrame([(1, 1, 2), (1, 2, 9)], "worker long, session long, quota long")
    given = sessions.deliver(queue, quotas)
    q, live, left = sessions.commit_delivery(queue, s, quotas, given, 100, 300)
    assert sorted(rows(live)) == [(1, 1, 400), (1, 2, 400), (1, 3, 70)] and rows(left) == [(1, 2, 6)]
    assert q.columns == queue.columns and q.where("not delivered").count() == 0 and q.count() == 6
    assert sessions.deliver(q, left).count() == 0
    bare, _, _ = sessions.commit_delivery(queue.drop("delivered"), s, quotas, given.limit(0), 100)
    assert bare.where("not delivered").count() == 6


def test_the_loop_from_grant_to_result(spark):
    made = lambda data, kinds: spark.createDataFrame(data, kinds)
    keep = lambda d, _: made(d.collect(), d.schema)
    one = made([(1, 1)], "worker long, session long")
    shard = Shard.empty(spark, CollectionConfig("test", task_assignments=1))
    assert rows(shard.deliver(one, 0)[2]) == [(1, 1)]  # not found
    shard, opened = shard.open(made([(1, 0, 0)], "worker long, time long, seq long"))
    assert rows(opened) == [(1, 1, 300)]
    shard, granted, rejected = shard.grant(made([(1, 1, 5)], "worker long, session long, n long"))
    assert rows(granted) == [(1, 1, 5, 5)] and rows(rejected) == []
    assert rows(sessions.pending(shard.quotas, made([(1, 1), (1, 9999)], "worker long, session long")), "session") == [(1, 1, 5), (1, 9999, 0)]
    tasks = made([(128 + i, f"item_{i}") for i in range(16)], "offset long, item string")
    shard, status = shard.assign(tasks, 0)
    assert rows(status) == [("test", 0, "NO_WORKERS", 132, 5)]
    shard = shard.kept(keep)
    again, status = shard.assign(tasks, 0)
    assert rows(status.select("code", "progress", "assigns")) == [("NO_WORKERS", 132, 0)] and again.queue.count() == 5
    shard, given, unknown = shard.deliver(one, 10)
    assert rows(unknown) == []
    assert rows(given.select("offset"), "offset") == [(o,) for o in range(128, 133)]
    assert rows(shard.sessions) == [(1, 1, 310)] and rows(shard.quotas) == []
    shard, done = shard.kept(keep).ack(made([(1, 128 + i, i % 2, i) for i in range(4)], "worker long, offset long, status int, seq long"))
    assert rows(done.select("offset", "item", "status"), "offset") == [(128 + i, f"item_{i}", i % 2) for i in range(4)]
    assert rows(shard.queue.select("offset", "item")) == [(132, "item_4")]
    assert shard.expire(60)[1].count() == 0 and rows(shard.expire(61)[1].select("offset", "status")) == [(132, 2)]
    shard, dead = shard.close(one)
    assert rows(dead.select("offset", "item", "status")) == [(132, "item_4", 2)] and shard.queue.count() == 0


def test_replicas_placed_before_count(spark):
    made = lambda data, kinds: spark.createDataFrame(data, kinds)
    shard = Shard.empty(spark, CollectionConfig("test", task_assignments=3))
    shard, _ = shard.open(made([(w, 0, 0) for w in (1, 2, 3, 4)], "worker long, time long, seq long"))
    shard, *_ = shard.grant(made([(1, 1, 1), (2, 1, 1)], "worker long, session long, n long"))
    tasks = made([(7, "a"), (8, "b")], "offset long, item string")
    shard, status = shard.assign(tasks, 0)
    assert rows(status.select("code", "progress", "assigns")) == [("NO_WORKERS", None, 2)]
    shard = shard.kept(lambda d, _: made(d.collect(), d.schema))
    shard, *_ = shard.grant(made([(3, 1, 1), (4, 1, 1)], "worker long, session long, n long"))
    shard, status = shard.assign(tasks, 0)
    assert rows(status.select("code", "progress", "assigns")) == [("NO_WORKERS", 7, 2)]
    assert sorted(rows(shard.queue.select("offset", "worker"))) == [(7, 1), (7, 2), (7, 3), (8, 4)] and rows(shard.placed) == [(8, 1)]


def test_delivery_and_ack(spark):
    queue = spark.createDataFrame([(1, 128 + i, f"item_{i}", 1000) for i in range(5)], "worker long, offset long, item string, exp_time long")
    s = spark.createDataFrame([(1, 1, 2), (1, 2, 9)], "worker long, session long, quota long")
    assert [(r.session, r.offset) for r in sessions.deliver(queue, s).orderBy("offset").collect()] == [(1, 128), (1, 129), (2, 130), (2, 131), (2, 132)]
    assert len(sessions.batches(sessions.deliver(queue, s)).orderBy("session").first().assignments) == 2
    with pytest.raises(Exception, match="empty item at offset 9"):
        sessions.deliver(spark.createDataFrame([(1, 9, "", 1)], queue.schema), s).collect()
    reports = spark.createDataFrame([(1, 128, 0, 1), (1, 129, 1, 2), (1, 130, 0, 3), (1, 131, 1, 4), (1, 131, 0, 5), (1, 7, 0, 6)], "worker long, offset long, status int, seq long")
    left, done, count = results.ack(queue, reports)
    assert [(r.offset, r.item, r.status) for r in done.orderBy("offset").collect()] == [(128, "item_0", 0), (129, "item_1", 1), (130, "item_2", 0), (131, "item_3", 1)]
    assert rows(left) == [(1, 132, "item_4", 1000)] and rows(count) == [(1, 4)]
    dead = sessions.dead_letter(left, s.where("false"))
    assert rows(results.union_results(dead).select("offset", "item", "status")) == [(132, "item_4", 2)]


def test_task_expiry_is_from_the_head(spark):
    queue = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 50), (1, 3, "c", 5), (2, 1, "d", 9), (2, 2, "e", 10)], "worker long, offset long, item string, exp_time long")
    live, gone = results.expire_tasks(queue, 10)
    assert sorted(r.item for r in live.collect()) == ["b", "c", "e"] and sorted((r.item, r.status) for r in gone.collect()) == [("a", 2), ("d", 2)]


def test_pointers(spark):
    p = spark.sql("select named_struct('collection', 'a', 'id', '1') dst, timestamp_seconds(3) timestamp")
    assert results.route_discovered(p).first().topic == "a.discovered"
    m = results.task_messages(p, "x").first()
    assert m.topic == "x.tasks" and bytes(m.key) == b"1"
    bad = spark.sql("select named_struct('collection', 'a', 'id', '') dst, timestamp_seconds(3) timestamp")
    with pytest.raises(Exception, match="bad pointer"):
        results.route_discovered(bad).collect()


RATE = [(1000, 1, 0), (1000, 5, 0), (1000, 5, 5000), (1000, 5, 10000), (1001, 0, 10000), (1002, 0, 10000), (1003, 0, 10000), (1004, 0, 10000), (1005, 0, 10000), (1006, 0, 7000), (1007, 0, 3999), (1008, 3, 3999), (1009, 0, 1000), (1010, 0, 0)]


def test_rate_limit(spark):
    r = ratelimit.RateLimit(1.0, 5)
    assert [int(r.count(t, x) * 1000) for t, x, _ in RATE] == [b for _, _, b in RATE]
    calls = spark.createDataFrame([("k", t, x, i) for i, (t, x, _) in enumerate(RATE)], "key string, t long, x long, seq long")
    got = [r.scaled_ban for r in ratelimit.rate_limit(calls, "key", "t", "x", "seq", 5, 5).orderBy("seq").collect()]
    assert [round(1000 * b / 5) for b in got] == [b + (b == 3999) for _, _, b in RATE]


def test_tokens(spark):
    secret, id_ = bytes([3]) + bytes(31), bytes(range(16))
    d = spark.createDataFrame([(bytearray(id_),)], "id binary")
    row = d.select(tokens.sign("id", secret).alias("tag"), tokens.serialize(tokens.sign("id", secret), "id").alias("t")).first()
    assert bytes(row.tag).hex() == "aad65b4a83fe759107c67fd46f84f8f3" and bytes(row.t) == b"\x0b" + bytes(row.tag) + id_
    text = spark.createDataFrame([(row.t,)], "t binary").select(tokens.marshal("t").alias("x")).first().x
    assert len(text) == 45 and text[0] == "H"
    bad = ["", text + "A", text[:-1], "I" + text[1:], text[:-1] + "!", None]
    got = spark.createDataFrame([(x,) for x in [text, *bad]], "x string").select(tokens.unmarshal("x").alias("r")).collect()
    assert bytes(got[0].r) == bytes(row.t) and all(r.r is None for r in got[1:])
    store, made = tokens.empty(spark), []
    for i in range(4):
        store, t = tokens.create(store, 1, f"d{i}", secret, None)
        made.append(t)
    assert all(len(r.id) == 22 and len(r.token_bit) == 4 for r in tokens.listed(store, 1).collect())
    other, _ = tokens.create(tokens.empty(spark), 1, "x", bytes([4]) + bytes(31), None)
    _, wrong = tokens.create(tokens.empty(spark), 1, "x", bytes([4]) + bytes(31), None, id_=id_)
    _, unknown = tokens.create(tokens.empty(spark), 1, "x", secret, None)
    req = spark.createDataFrame([(i, f"Bearer {x}") for i, x in enumerate([made[0], "junk", wrong, unknown])], "n int, authorization string")
    assert [(r.verdict, r.worker_id) for r in tokens.authenticate(req, store, secret).orderBy("n").collect()] == [("ok", 1), ("corrupt", None), ("bad_mac", None), ("unknown", None)]
    third = bytes(store.where("description = 'd3'").first().id)
    store, found = tokens.revoke(store, 1, third)
    assert found and store.count() == 3 and not tokens.revoke(store, 1, third)[1] and not tokens.revoke(store, 2, bytes(16))[1]
    store, n = tokens.revoke_all(store, 1)
    assert n == 3 and store.count() == 0


def test_cache(spark):
    e = spark.createDataFrame([(i, i, "v") for i in range(64)] + [(100 + i, 1000 + i, "v") for i in range(8)], "id long, ts long, v string")
    c = tokens.cached(e, "id", "ts", 2_592_000, 16, 1100)
    assert c.count() == 16 and {r.id for r in c.collect()} >= set(range(100, 108))
    assert tokens.cached(e, "id", "ts", 100, 16, 1100).count() == 8
    odd = spark.createDataFrame([(101,), (103,), (105,), (107,)], "id long")
    assert {r.id for r in tokens.apply_invalidations(c, odd).where("id >= 100").collect()} == {100, 102, 104, 106}
    assert tokens.oldest(e, "ts").first().id == 0
    log = tokens.add_invalidation(spark.createDataFrame([(1, 1), (2, 2)], "id long, seq long"), spark.createDataFrame([(3, 3)], "id long, seq long"), 2)
    assert {r.id for r in log.collect()} == {2, 3}


def test_collection_stats(spark):
    t = spark.createDataFrame([(0, "yt.videos"), (1, "some.collection"), (2, "no")], "position int, name string")
    got = items.collection_stats(t, {"yt_videos_items": spark.range(128), "some_collection_items": spark.range(256)})
    assert rows(got) == [(0, "yt.videos", 128), (1, "some.collection", 256), (2, "no", 0)]
    assert rows(items.collection_stats(t, {}).select("item_count")) == [(0,)] * 3


def test_metrics_and_dumps(spark):
    b = spark.createDataFrame([("c", 0, 3, 1), ("c", 0, 4, 0)], "collection string, partition int, items long, new_items long")
    m = metrics.discovery_metrics(b)
    assert rows(m) == [("c", 0, 2, 7, 1)]
    assert 'questrel_items{collection="c",partition="0"} 7' in [r.line for r in metrics.exposition(m).collect()]
    log = spark.createDataFrame([(2, b"b"), (1, b"a")], "offset long, key binary")
    assert [r.line for r in admin.dump_log(log).collect()] == ['{"offset":1,"key":"a"}', '{"offset":2,"key":"b"}']
    d = admin.dump_state(offset=spark.createDataFrame([(7, 9)], "k long, v long"))
    assert rows(d) == [("offset", "7", '{"v":9}')]
    assert metrics.observed(log, "x").count() == 2
    assert N.KINDS == ("tasks", "discovered", "results")
