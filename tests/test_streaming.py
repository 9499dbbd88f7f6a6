"""Streams fed file by file give what the batch operators give."""

import datetime as dt
import random

from ringwatch.operators import joins as J
from ringwatch.operators import windows as W
from ringwatch.schema import EVENT_TYPES
from ringwatch.streaming import operators as S

START = dt.datetime(2024, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


def run(spark, tmp_path, kind, batches, build, name):
    source = tmp_path / name
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source / f"b{k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    try:
        query.processAllAvailable()
        return spark.sql(f"select * from {name}").collect()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.shuffle.partitions")


EVENT = "node_id string, ts timestamp, ts_end timestamp, duration_ms double"
FAR = ("z", at(90_000), at(90_000), 0.0)


def test_tumbling(spark, tmp_path):
    rows = run(spark, tmp_path, EVENT, [[("n", at(10), at(11), 5.0), ("n", at(20), at(21), 7.0)], [("n", at(2000), at(2001), 1.0)], [FAR]], lambda s: S.stream_log_aggregation(s, ["node_id"]), "t1")
    assert sorted((r.bucket, r["count"], r.duration_sum) for r in rows) == [(at(0), 2, 12.0), (at(1800), 1, 1.0)]


BEGIN, ITEM, END, ONE, SKIP = (EVENT_TYPES[k] for k in ("SessionBegin", "SessionItem", "SessionEnd", "SingleInstance", "SessionIgnore"))


def late_batches(rows, reach, far, seed):
    """rows (second, row) dealt to batches so that none is more than `reach` seconds behind a row of an earlier batch."""
    draw = random.Random(seed)
    moved = [row for _, row in sorted((s + draw.random() * reach, row) for s, row in rows)]
    cuts = sorted(draw.sample(range(1, len(moved)), 4))
    return [moved[a:b] for a, b in zip([0, *cuts], [*cuts, len(moved)], strict=True)] + [[f] for f in far]


def test_sessions(spark, tmp_path):
    kind = "node_id string, session_key string, event_id long, ts timestamp, type long"
    draw = random.Random(5)
    events = [(s, ("n", draw.choice("sq"), k, at(s), draw.choice([BEGIN, BEGIN, BEGIN | ITEM, ITEM, ITEM | ONE, ITEM | SKIP, END, END, END, None]))) for k, s in enumerate(draw.choices(range(1500), k=150))]
    far = [("z", "z", 900 + k, at(90_000 + 4000 * k), BEGIN) for k in range(3)]
    got = run(spark, tmp_path, kind, late_batches(events, 590, far, 7), S.stream_sessions, "t2")
    fields = ["node_id", "session_key", "event_id", "ts", "type", "session_id", "ts_begin", "duration_ms", "orphaned"]
    key = lambda r: tuple(str(r[f]) for f in fields)
    want = J.pair_sessions(spark.createDataFrame([row for _, row in events], kind)).collect()
    assert sorted(map(key, [r for r in got if r.node_id == "n"])) == sorted(map(key, want))
    assert sum(not r.orphaned for r in want) > 10


def test_sessions_end_by_time(spark, tmp_path):
    kind = "node_id string, session_key string, event_id long, ts timestamp, type long"
    events = [("n", "s", 1, at(0), BEGIN), ("n", "s", 2, at(50), ITEM), ("n", "s", 3, at(101), END)]
    for name, batches in (("t2a", [events]), ("t2b", [[e] for e in events])):
        got = run(spark, tmp_path, kind, [*batches, [("z", "z", 9, at(90_000), END)]], lambda s: S.stream_sessions(s, orphan_after=100), name)
        assert sorted((r.event_id, r.session_id, r.orphaned) for r in got if r.node_id == "n") == [(1, "1", True), (2, "1", False), (3, None, True)]


def test_bursts_and_frames(spark, tmp_path):
    times = [(0, 1), (1.1, 2), (2.05, 3), (10, 11), (400, 401), (401.1, 402)]
    events = [("n", at(b), at(e), (e - b) * 1000.0) for b, e in times]
    batches = [events[:2], events[2:4], events[4:], [FAR], [("z", at(90_001), at(90_001), 0.0)]]
    batch = spark.createDataFrame(events, EVENT).withColumnRenamed("ts", "ts_begin")
    key = lambda r: (r.run_begin, r.run_end, r.occurrences, round(r.duration_sum))
    got = run(spark, tmp_path, EVENT, batches, S.stream_back_to_back, "t3")
    assert sorted(map(key, got)) == sorted(map(key, W.gc_back_to_back(batch).collect())) != []
    got = run(spark, tmp_path, EVENT, batches, lambda s: S.stream_time_frame(s, frame_ms=20_000, least_ms=1_000), "t4")
    assert sorted(map(key, got)) == sorted(map(key, W.gc_time_frame(batch, frame_ms=20_000, least_ms=1_000).collect())) != []


def test_late_bursts_and_deltas(spark, tmp_path):
    draw = random.Random(3)
    times = sorted(draw.choices(range(4000), k=200))
    events = [(s, ("n", at(s), at(s + draw.choice([1, 5, 30])), draw.choice([1000.0, 5000.0, None]))) for s in times]
    batches = late_batches(events, 590, [FAR, ("z", at(95_000), at(95_000), 0.0)], 1)
    batch = spark.createDataFrame([row for _, row in events], EVENT).withColumnRenamed("ts", "ts_begin")
    key = lambda r: (r.run_begin, r.run_end, r.occurrences, r.duration_sum, r.duration_max)
    got = run(spark, tmp_path, EVENT, batches, lambda s: S.stream_back_to_back(s, tolerance_ms=2_000), "t3l")
    want = W.gc_back_to_back(batch, tolerance_ms=2_000).collect()
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, want))) != []
    got = run(spark, tmp_path, EVENT, batches, lambda s: S.stream_time_frame(s, frame_ms=20_000, least_ms=1_000), "t4l")
    want = W.gc_time_frame(batch, frame_ms=20_000, least_ms=1_000).collect()
    assert [r.run_begin for r in sorted(got, key=key)] == [r.run_begin for r in sorted(want, key=key)] != []
    kind = "node_id string, name string, ts timestamp, value double"
    counts = [(s, ("n", "c", at(s), draw.choice([5.0, 9.0, 20.0]))) for s in sorted(set(times))]
    far = [("z", "c", at(90_000 + k), 1.0) for k in range(2)]
    got = [r for r in run(spark, tmp_path, kind, late_batches(counts, 590, far, 2), S.stream_deltas, "t5l") if r.node_id == "n"]
    want = W.delta_running_total(spark.createDataFrame([row for _, row in counts], kind), "value", ["node_id", "name"], ["ts"]).collect()
    assert sorted((r.ts, str(r.delta)) for r in got) == sorted((r.ts, str(r.delta)) for r in want)


def test_deltas_and_duplicates(spark, tmp_path):
    kind = "node_id string, name string, ts timestamp, value double"
    rows = run(spark, tmp_path, kind, [[("n", "c", at(0), 5.0), ("n", "c", at(1), 9.0)], [("n", "c", at(2), 3.0)], [("z", "c", at(9_000), 1.0)]], S.stream_deltas, "t5")
    assert [r.delta for r in sorted(rows, key=lambda r: r.ts) if r.node_id == "n"] == [None, 4.0, 3.0]
    kind = "node_id string, src_file string, src_line int, message string, ts timestamp"
    line = ("n", "A", 1, "m", at(0))
    rows = run(spark, tmp_path, kind, [[line, line], [line, ("n", "A", 1, "other", at(1))]], S.stream_distinct_lines, "t6")
    assert sorted(r.message for r in rows) == ["m", "other"]


def test_a_batch_writes_its_new_rows_only(spark, tmp_path):
    """Forty batches of one key within the watermark's delay: what a batch writes to the state doesn't grow with what waits."""
    kind, source = "node_id string, name string, ts timestamp, value double", tmp_path / "many"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for k in range(12):
        spark.createDataFrame([("n", "c", at(10 * k + j / 20), float(j)) for j in range(100)], kind).coalesce(1).write.mode("append").parquet(str(source / f"b{k:02}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = S.stream_deltas(stream, late="1 hour").writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        metrics = [dict(p["stateOperators"][0]["customMetrics"]) for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
        spark.conf.unset("spark.sql.shuffle.partitions")
    written = [m["rocksdbTotalBytesWritten"] for m in metrics]
    assert len(written) == 12 and max(written[6:]) < 2 * max(written[1:6]), metrics[-1]
