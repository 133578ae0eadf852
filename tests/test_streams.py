import random

import pytest
from pyspark.sql import functions as F

from questrel.operators.items import apply_results, insert_ignore, merged, new_rows, result_rows
from questrel.operators.nassign import ShardState, assign
from questrel.sources import logs
from questrel.sources.versions import ChangedTable, VersionedTable
from questrel.streaming import assigner, pipelines

ITEMS = "item_id string, found_t timestamp, last_update timestamp, updates long"


def test_log_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    logs.append_log(logs.generate(spark, "yt.videos.tasks", 10, first=5), path)
    d = logs.decode(logs.read_log(spark, path), "collection string, id string")
    assert [(r.offset, r.collection, r.id) for r in d.orderBy("offset").collect()][:2] == [(5, "yt.videos", "item_0"), (6, "yt.videos", "item_1")]
    bad = logs.read_log(spark, path).withColumn("value", F.lit("{").cast("binary"))
    with pytest.raises(Exception):
        logs.decode(bad, "collection string, id string").collect()
    assert logs.decode(bad, "collection string, id string", strict=False).where("id is not null").count() == 0
    topics = logs.topics_of(spark.createDataFrame([("a.b",)], "name string"), "results")
    assert topics.first().topic == "a.b.results"


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id long")
    assert t.read().count() == 0 and t.versions() == []
    t.write(spark.range(3), 0)
    t.write(spark.range(9), 0)  # the batch again: no effect
    t.write(spark.range(5), 1)
    assert t.read().count() == 5 and t.read(before=1).count() == 3 and t.versions() == [0, 1]
    t.vacuum(1)
    assert t.versions() == [1]


def test_changes_cost_as_much_as_their_batch(spark, tmp_path):
    rng = random.Random(5)
    at = lambda rows, name: spark.createDataFrame(rows, "item_id string, t long, seq long").select("item_id", F.timestamp_seconds("t").alias(name), "seq")
    items, plain = ChangedTable(spark, f"file://{tmp_path}/items", ITEMS, merged, 3), spark.createDataFrame([], ITEMS)
    assert items.read().count() == 0 and items.live() == []
    for v in range(11):
        rows = [(str(rng.randint(0, 20)), rng.choice([None, *range(9)]), 4 * v + i) for i in range(4)]
        if v % 2:
            d = at(rows, "timestamp")
            before = items.changes(before=v)
            add = new_rows(before, d).join(before.select("item_id"), "item_id", "left_anti")
            plain = insert_ignore(plain, d)
        else:
            d = at(rows, "finish_time")
            add, plain = result_rows(d), apply_results(plain, d)
        plain = spark.createDataFrame(plain.collect(), ITEMS)
        items.write(add, v)
        items.write(add.limit(0), v)  # the batch again: no effect
        assert spark.read.parquet(f"file://{tmp_path}/items/at={v}/upto={v}").count() <= 4
        items.compact(v)
        items.compact(v)
        assert items.live()[-1] == (v, v) and len(items.live()) <= 3 * 3
        assert sorted(map(str, items.read().collect())) == sorted(map(str, plain.collect()))
    assert items.live() == [(0, 8), (9, 9), (10, 10)]
    items.write(add.limit(0), 4)  # within a merged folder
    assert (4, 4) not in items.parts()


def test_discovery_over_batches(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    batches = [[("1", 3, 0), ("2", 3, 1)], [("2", 5, 2), ("3", 9, 3), ("3", 10, 4)]]
    schema = "dst struct<collection:string,id:string>, timestamp timestamp, seq long"
    items, tasks = ChangedTable(spark, f"file://{tmp_path}/items", ITEMS, merged), VersionedTable(spark, f"file://{tmp_path}/tasks", "topic string, key binary, value binary")
    for b in batches:
        d = spark.createDataFrame([(("c", i), t, s) for i, t, s in b], "dst struct<collection:string,id:string>, t long, seq long")
        d.select("dst", F.timestamp_seconds("t").alias("timestamp"), "seq").coalesce(1).write.mode("append").parquet(src)
        pipelines.discovery(spark.readStream.schema(schema).parquet(src), items, tasks, "c", f"file://{tmp_path}/cp").awaitTermination()
    got = items.read().select("item_id", F.unix_timestamp("found_t").alias("t")).orderBy("item_id").collect()
    assert [tuple(r) for r in got] == [("1", 3), ("2", 3), ("3", 10)]
    assert [bytes(r.key) for r in tasks.read().collect()] == [b"3"]


def test_results_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    every = [(str(rng.randint(0, 5)), rng.randint(0, 99), i) for i in range(60)]
    raw = spark.createDataFrame(every, "item_id string, t long, seq long").select("item_id", F.timestamp_seconds("t").alias("finish_time"), "seq")
    src, store = f"file://{tmp_path}/in", ChangedTable(spark, f"file://{tmp_path}/items", ITEMS, merged, 2)
    for lo in range(0, 60, 20):
        raw.where(f"seq >= {lo} and seq < {lo + 20}").coalesce(1).write.mode("append").parquet(src)
        pipelines.reporter(spark.readStream.schema(raw.schema).parquet(src), store, f"file://{tmp_path}/cp").awaitTermination()
    want = apply_results(spark.createDataFrame([], ITEMS), raw)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want.collect()))


def test_events_run_in_order():
    s = ShardState()
    out, waiting = assigner.run_events(s, [], [("task", None, None, 1, "a"), ("task", None, None, 2, "b"), ("grant", 7, 1, None, None)], 1)
    assert out == [(7, 1, "a", 0)] and waiting == [(2, "b")]
    out, waiting = assigner.run_events(s, waiting, [("grant", 8, 5, None, None), ("close", 8, None, None, None), ("task", None, None, 3, "c"), ("task", None, None, 1, "a")], 1)
    assert out == [(8, 2, "b", 0)] and waiting == [(3, "c")]


def test_assigner_stream_equals_fold(spark, tmp_path):
    events = [("c", 0, i, "grant", i, 50, None, None) for i in range(5)] + [("c", 0, 10 + i, "task", None, None, i, str(i)) for i in range(60)]
    src = f"file://{tmp_path}/in"
    for lo in (0, 30):
        spark.createDataFrame([e for e in events if lo <= e[2] < lo + (30 if not lo else 100)], assigner.EVENTS).coalesce(1).write.mode("append").parquet(src)
        out = assigner.assigner(spark.readStream.schema(assigner.EVENTS).parquet(src), 3)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(assigner.OUT).parquet(f"file://{tmp_path}/out").select("worker", "offset", "item", "replica").collect()
    s = ShardState()
    for w in range(5):
        s.grant(w, 50)
    assert sorted(map(tuple, got)) == sorted(assign(s, iter([(i, str(i)) for i in range(60)]), 3))


def test_worker_states(spark, tmp_path):
    from questrel.streaming import workers as w

    e = [(1, 0, 10, "open", None, None, None, None, None)]
    e += [(1, 1 + i, 11, "assign", None, 128 + i, f"item_{i}", 71 + i, None) for i in range(5)]
    e += [(1, 10, 20, "ack", None, 128, None, None, 0), (1, 11, 20, "ack", None, 129, None, None, 1), (1, 12, 21, "ack", None, 129, None, None, 0)]
    e += [(1, 13, 74, "refresh", 1, None, None, None, None), (1, 14, 75, "close", 9, None, None, None, None)]
    e += [(2, 15, 10, "open", None, None, None, None, None), (2, 16, 10, "assign", None, 5, "x", 999, None), (2, 17, 311, "open", None, None, None, None, None)]
    last = [(1, 20, 75, "close", 1, None, None, None, None)]
    src = f"file://{tmp_path}/in"
    for part in (e, last):
        spark.createDataFrame(part, w.EVENTS).coalesce(1).write.mode("append").parquet(src)
        out = w.results(spark.readStream.schema(w.EVENTS).parquet(src), timers=False)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(w.OUT).parquet(f"file://{tmp_path}/out").collect()))
    assert got == [(1, 128, "item_0", 0, 71), (1, 129, "item_1", 1, 72), (1, 130, "item_2", 2, 73), (1, 131, "item_3", 2, 74), (1, 132, "item_4", 2, 75), (2, 5, "x", 2, 999)]
    s = w.WorkerState(1, {1: 50}, {3: ("a", 40)})
    assert s.next_time() == 40 and w.WorkerState().next_time() == 0 and w.WorkerState.load(s.dump()) == s
    assert s.expire(40) == [] and s.expire(51) == [(3, "a", 2, 40)] and s.sessions == {}


def test_command_line(capsys):
    from questrel.__main__ import main

    assert main(["queries"]) == 0 and "nassign_fold" in capsys.readouterr().out
    assert main([]) == 2
