"""The whole flows: a log with its exceptions, tags and orphans to aggregated rows; statistics to tagged tables; files to coverage."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ringwatch.operators import events as E
from ringwatch.plans import flows
from ringwatch.schema import EVENT_CLASSES, ORPHANED
from ringwatch.sources import logs as L
from ringwatch.sources import text as T

START = datetime(2024, 1, 1)


def hour(h):
    return START + timedelta(hours=h)


def test_tagged_flow_gives_each_attribute_its_rollup(spark):
    rows = [("d", "k", f"t{t}", f"n{n}", a, v) for t, high in ((1, 90.0), (2, 1.0)) for n in range(3) for a, v in (("Read", high), ("Read", high / 2), ("Write", 1.0))]
    df = spark.createDataFrame(rows, "dc string, keyspace string, table_name string, node_id string, attr string, num_value double")
    tagged, rollups = flows.tagged_flow(df, {"read_latency": "Read", "write_latency": "Write"}, 0.0)
    got = {r.table_name: r for r in tagged.collect()}
    assert set(got) == {"t1", "t2"} and got["t1"].read_latency_max == 90.0 and got["t1"].read_latency_weight > got["t2"].read_latency_weight
    assert set(rollups) == {"read_latency", "write_latency"}
    one = {r.table_name: r for r in rollups["read_latency"].collect()}
    assert one["t1"].n == 1 and abs(one["t1"].factor - got["t1"].read_latency_weight) < 1e-9  # (w + w) / 2 of one data center


def test_coverage_flow(spark):
    files = [("d", "n1", False, "a", 0, 5), ("d", "n1", False, "b", 5.1, 8), ("d", "n1", False, "c", 10, 12), ("d", "n2", False, "e", 0, 4)]
    df = spark.createDataFrame([(d, n, b, p, hour(a), hour(z)) for d, n, b, p, a, z in files], "dc string, node_id string, is_debug boolean, path string, used_min timestamp, used_max timestamp")
    node, dc = flows.coverage_flow(df)
    got = {r.node_id: (round(r.hours, 3), round(r.gap_hours, 3), r.files) for r in node.collect()}
    assert got == {"n1": (7.9, 2.0, 3), "n2": (4.0, 0.0, 1)}
    (one,) = dc.collect()
    assert round(one.hours_avg, 3) == 5.95 and round(one.gap_hours, 3) == 2.0 and one.files == 4


LOG = """INFO  [CompactionExecutor:1] 2024-01-01 00:00:01,000 CompactionTask.java:141 - Compacting [x]
INFO  [CompactionExecutor:1] 2024-01-01 00:00:03,000 CompactionTask.java:274 - Compacted 4 sstables to [y]
INFO  [CompactionExecutor:2] 2024-01-01 00:00:05,000 CompactionTask.java:141 - Compacting [x]
INFO  [Service:1] 2024-01-01 00:00:06,000 GCInspector.java:282 - ParNew GC in 350ms.
WARN  [Service:1] 2024-01-01 00:00:07,000 GCInspector.java:282 - ParNew GC in 450ms.
"""


def test_kinds_of_events_are_rows_whatever_their_level(spark, tmp_path):
    (tmp_path / "10.0.0.1").mkdir()
    (tmp_path / "10.0.0.1" / "system.log").write_text(LOG)
    got = {r.related: r for r in flows.log_to_aggregation(T.read_log_lines(spark, str(tmp_path / "10.0.0.1" / "system.log"))).collect()}
    assert set(got) == {"GC", "Compaction"} and got["GC"]["count"] == 2 and got["GC"].kind == EVENT_CLASSES["GC"]
    assert got["Compaction"]["count"] == 1 and got["Compaction"].duration_max == 2000.0
    # the same log through the data source that reads a range of time
    rows = L.read_log_range(spark, str(tmp_path / "10.0.0.1" / "system.log")).filter(F.col("ts") >= "2024-01-01 00:00:06")
    events = E.classify_events(T.parse_header(L.assemble_log_records(rows)), flows.RULES)
    assert sorted((r.tag, r.level) for r in events.collect()) == [("gc", "INFO"), ("gc", "WARN")]


def test_group_keys_tell_exceptions_tags_and_nodes_apart(spark):
    gc = EVENT_CLASSES["GC"]
    rows = [(1, gc, "young", ["b", "a"], {"tag": "x"}, ["A", "B"]), (2, gc | EVENT_CLASSES["Warning"] | ORPHANED, "young", ["a", "b", "a"], {"tag": "x"}, ["A", "B"]), (3, gc, None, None, None, None), (4, gc, None, [], {}, [])]
    df = spark.createDataFrame(rows, "event_id long, class long, subclass string, assoc_nodes array<string>, props map<string,string>, exception_path array<string>")
    got = {r.event_id: (r.kind, r.related, r.exception, r.exception_at, r.keyspace) for r in E.with_group_key(df).collect()}
    assert got[1] == got[2] == (gc, "GC(young) [a, b] Tag{x}", "A", "A=>B", None) and got[3] == got[4] == (gc, "GC", None, None, None)
    assert E.with_group_key(df).columns[: len(df.columns)] == df.columns
