from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from questrel import model
from questrel.functions import naming as N


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_topics(spark):
    names = ["yt.videos.tasks", "", ".", ".items", "items", "yt.videos."]
    assert one(spark, *[N.collection_of_topic(F.lit(t)) for t in names]) == ("yt.videos", "", "", "", "", "yt.videos")
    assert one(spark, N.topic_name(F.lit("yt.videos"), "tasks")) == ("yt.videos.tasks",)
    assert one(spark, N.table_name(F.lit("yt.videos")), N.table_name(F.lit("a.b.c")), N.table_name(F.lit("a"))) == ("yt_videos_items", "a_b.c_items", "a_items")


def test_packing_of_numbers(spark):
    for n in (0, 1, 255, 2**40 + 7, 2**62):
        packed, back = one(spark, N.big_endian(F.lit(n).cast("long")), N.from_big_endian(N.big_endian(F.lit(n).cast("long"))))
        assert bytes(packed) == n.to_bytes(8, "big") and back == n
    key, shard = one(spark, N.session_key(F.lit(1).cast("long"), F.lit(2).cast("long")), N.shard_key(F.lit("t"), F.lit(-1), 0x30))
    assert bytes(key) == bytes(7) + b"\1" + bytes(7) + b"\2"
    assert bytes(shard) == b"t\0\xff\xff\xff\xff\x30"


def test_base64(spark):
    for data in (b"", b"a", b"ab", b"abc", bytes(range(250, 256))):
        url, back = one(spark, N.base64_url(F.lit(data)), N.from_base64_url(N.base64_url(F.lit(data))))
        assert "=" not in url and "+" not in url and "/" not in url and bytes(back) == data
    assert one(spark, N.from_base64_url(F.lit("a!")), N.from_base64_url(F.lit("abcde"))) == (None, None)


def test_small_functions(spark):
    assert one(spark, N.bearer_token(F.lit("Bearer x")), N.bearer_token(F.lit("x Bearer y")), N.queue_entry_offset(F.lit("132-1"))) == ("x", "x Bearer y", 132)
    assert one(spark, N.status_name(F.lit(0)), N.status_name(F.lit(2)), N.status_name(F.lit(9))) == ("SUCCESS", "TIMEOUT", None)
    flat = F.array(*[F.lit(x) for x in ("item", "a", "exp_time", "5", "item", "b")])
    assert one(spark, N.fields_to_map(flat), N.fields_to_map(F.array().cast("array<string>"))) == ({"item": "b", "exp_time": "5"}, {})


def test_durations():
    assert [model.seconds(x) for x in ("250ms", "5m", "1h30m", "2s", 7)] == [0.25, 300, 5400, 2, 7]
    for bad in ("", "5", "m", "5x"):
        if bad:
            with pytest.raises(ValueError):
                model.seconds(bad)


def test_topology(spark):
    t = model.read_topology('[[collections]]\nname = "yt.videos"\npk_type = "BIGINT UNSIGNED"\ntask_timeout = "2m"\n[[collections]]\nname = "b"\n')
    assert t.get("yt.videos").task_timeout == timedelta(minutes=2) and t.get("b").task_assignments == 3 and t.get("c") is None
    rows = t.to_df(spark).orderBy("position").collect()
    assert [r.name for r in rows] == ["yt.videos", "b"] and rows[1].assign_interval == 0.25 and rows[0].session_timeout == 300
    assert model.read_topology("").to_df(spark).count() == 0
    with pytest.raises(ValueError):
        model.read_topology("[[collections]]\nname = 'x'\nodd = 1\n")
