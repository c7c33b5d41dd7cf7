"""The record store's versions, the audit stream's replays, and rolling counts in slices."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.operators import windows as wn
from covenant.sources import store as st
from covenant.streaming import audit as au

RECORD = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("content", T.StringType())])


def make(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def contents(df):
    return {r.k: (r["at"], r.content) for r in df.collect()}


def test_versions_and_readers(spark, tmp_path):
    store = st.RecordStore(str(tmp_path / "s"), RECORD, ("k",), ("at",), buckets=8)
    assert store.version(spark) == 0 and store.read(spark).count() == 0
    assert store.upsert(make(spark, [])) == 0
    first = [(f"k{i}", 1, f"a{i}") for i in range(40)] + [(None, 1, "null"), ("k0", 0, "older")]
    assert store.upsert(make(spark, first)) == 1
    before = store.read(spark)                                                # a reader that opened version 1
    assert store.upsert(make(spark, [("k0", 2, "b0"), ("k1", 0, "late"), ("new", 5, "n"), ("new", 6, "n2")])) == 2
    want = {k: (at, c) for k, at, c in first[:-1]}
    assert contents(before) == want == contents(store.read(spark, version=1))
    assert contents(store.read(spark)) == want | {"k0": (2, "b0"), "new": (6, "n2")}


def test_only_touched_buckets_are_written_and_read(spark, tmp_path):
    store = st.RecordStore(str(tmp_path / "s"), RECORD, ("k",), ("at",), buckets=16)
    store.upsert(make(spark, [(f"k{i}", 1, "a") for i in range(200)]))
    store.upsert(make(spark, [("k7", 2, "b")]))
    assert len([p for p in (tmp_path / "s" / "data" / "version=2").iterdir() if p.is_dir()]) == 1
    found = store.lookup(spark.createDataFrame([("k7",), ("k7",)], "k string"))
    assert contents(found) == {"k7": (2, "b")}
    assert {f.rsplit("/", 2)[1] for f in found.inputFiles()} == {f.rsplit("/", 2)[1] for f in found.inputFiles()[:1]}
    assert store.lookup(spark.createDataFrame([("absent",)], "k string")).count() == 0


def test_an_upsert_that_died_leaves_the_old_version(spark, tmp_path):
    store = st.RecordStore(str(tmp_path / "s"), RECORD, ("k",), ("at",), buckets=4)
    store.upsert(make(spark, [("a", 1, "x"), ("b", 1, "y")]))
    make(spark, [("a", 9, "half")]).write.parquet(str(tmp_path / "s" / "data" / "version=2" / "store_bucket=0"))    # data without a manifest
    assert contents(store.read(spark)) == {"a": (1, "x"), "b": (1, "y")}
    assert store.upsert(make(spark, [("a", 2, "z")])) == 2
    assert contents(store.read(spark)) == {"a": (2, "z"), "b": (1, "y")}


EVENT = T.StructType([T.StructField("at", T.TimestampNTZType()), T.StructField("id", T.IntegerType()), T.StructField("e", T.StringType()),
                      T.StructField("action", T.StringType())])


def trail_rows(trail, spark):
    return sorted((r.id, r.prev_id, r.prev_action, r.late) for r in trail.timeline(spark).collect())


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    zero = dt.datetime(2024, 1, 1)
    rng = random.Random(1)
    events = [(zero + dt.timedelta(minutes=10 * i), i, rng.choice(["a", "b", None]), f"x{i}") for i in range(60)]
    trail = au.AuditTrail(str(tmp_path / "t"), EVENT, ["e"], ["at", "id"], ["action", "id"])
    parts = [events[:20], events[20:45], events[45:]]
    for n, part in enumerate(parts):
        trail.append(spark.createDataFrame(part, EVENT), n)
        if n == 1:
            once = trail_rows(trail, spark)
            trail.append(spark.createDataFrame(part, EVENT), n)                # a retry after a failure
            assert trail_rows(trail, spark) == once
    want, last = [], {}
    for at, i, e, action in events:
        want.append((i, *(last.get(e) or (None, None)), False))
        last[e] = (i, action)
    assert trail_rows(trail, spark) == want


def test_late_and_same_time_events(spark, tmp_path):
    zero = dt.datetime(2024, 1, 1)
    trail = au.AuditTrail(str(tmp_path / "t"), EVENT, ["e"], ["at", "id"], ["action", "id"])
    trail.append(spark.createDataFrame([(zero, 5, "a", "first")], EVENT), 0)
    trail.append(spark.createDataFrame([(zero - dt.timedelta(days=1), 1, "a", "late"), (zero, 6, "a", "same time"), (zero, 2, "b", "other")], EVENT), 1)
    assert trail_rows(trail, spark) == [(1, None, None, True), (2, None, None, False), (5, None, None, False), (6, 5, "first", False)]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    zero = dt.datetime(2024, 1, 1)
    trail = au.AuditTrail(str(tmp_path / "t"), EVENT, ["e"], ["at", "id"], ["action", "id"])
    for n in range(3):
        spark.createDataFrame([(zero + dt.timedelta(hours=n), n, "a", f"x{n}")], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        trail.run(str(tmp_path / "in"), str(tmp_path / "ckpt"))
        trail.run(str(tmp_path / "in"), str(tmp_path / "ckpt"))
    assert trail_rows(trail, spark) == [(0, None, None, False), (1, 0, "x0", False), (2, 1, "x1", False)]


def test_rolling_count_with_hot_times_and_nulls(spark):
    zero, rng = dt.datetime(2024, 1, 1), random.Random(4)
    rows = [(i, rng.choice(["a", None]), zero + dt.timedelta(seconds=rng.randrange(20_000))) for i in range(400)]
    rows += [(1000 + i, "a", zero + dt.timedelta(seconds=3600)) for i in range(200)] + [(2000, "a", None), (2001, "a", zero), (2002, "a", zero + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "id int, g string, ts timestamp_ntz")
    out = wn.rolling_count(df, ["g"], "ts", 3600)
    assert out.columns == ["id", "g", "ts", "events_in_window"]
    got = {r.id: r.events_in_window for r in out.collect()}
    hour = dt.timedelta(hours=1)
    want = {i: None if t is None else sum(1 for _, g2, t2 in rows if g2 == g and t2 is not None and t - hour <= t2 <= t) for i, g, t in rows}
    assert got == want
    assert out.where(F.col("id") == 2000).first().events_in_window is None
