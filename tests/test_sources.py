import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from ringwatch.plans import flows
from ringwatch.sources import json as SJ
from ringwatch.sources import text as T

LOG = """stray line
INFO  [CompactionExecutor:1] 2024-01-01 00:00:01,500 CompactionTask.java:140 - Compacting (aa-1) [x]
INFO  [CompactionExecutor:1] 2024-01-01 00:00:03,500 CompactionTask.java:240 - Compacted (aa-1) 4 sstables
WARN  [Service Thread] 2024-01-01 00:01:00,000 GCInspector.java:282 - ParNew GC in 350ms.  Par Eden
ERROR [ReadStage-2] 2024-01-01 00:02:00,000 Other.java:7 - boom
java.lang.RuntimeException: boom
\tat a.B.c(B.java:1)
Caused by: java.io.IOException: disk
WARN  [ReadStage-2] 2024-01-01 00:03:00,000 ReadCommand.java:9 - Read 5 live rows and 3000 tombstone cells for query
"""


def test_log_text_to_events(spark, tmp_path):
    (tmp_path / "10.0.0.1").mkdir()
    (tmp_path / "10.0.0.2").mkdir()
    (tmp_path / "10.0.0.1/system.log").write_text(LOG)
    with gzip.open(tmp_path / "10.0.0.2/system.log.1.gz", "wt") as f:
        f.write(LOG)
    lines = T.read_log_lines(spark, str(tmp_path / "*"))
    assert [r.line_no for r in lines.filter("node_id = '10.0.0.1'").orderBy("line_no").collect()] == list(range(1, 10))
    rows = flows.log_flow(lines).orderBy("node_id", "line_no").collect()
    assert len(rows) == 10 and {r.node_id for r in rows} == {"10.0.0.1", "10.0.0.2"}
    first = rows[:5]
    assert [r.tag for r in first] == ["compaction_begin", "compaction_end", "gc", None, "tombstones"]
    assert first[2].props == {"collector": "ParNew", "pause_ms": "350"} and first[2].src_line == 282
    assert len(first[3].extra) == 3 and first[3].ts == dt.datetime(2024, 1, 1, 0, 2)
    assert first[4].props == {"live_cells": "5", "tombstones": "3000"}
    out = flows.log_to_aggregation(lines).collect()
    assert sorted(r["count"] for r in out) == [1] * 6
    assert {r.duration_max for r in out} == {None, 2000.0}


def test_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "10.0.0.1").mkdir()
    (tmp_path / "10.0.0.1/system.log").write_text("".join(f"line {k:05d}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = T.read_log_lines(spark, str(tmp_path / "10.0.0.1/system.log"))
        assert rows.select("block").distinct().count() > 1
        assert rows.filter(F.col("line") != F.format_string("line %05d", F.col("line_no") - 1)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def lines_of(spark, text, node="10.0.0.1"):
    return spark.createDataFrame([(f"/x/{node}", node, 0, k, line) for k, line in enumerate(text.split("\n"))], "path string, node_id string, block long, seq long, line string")


def test_table_stats(spark):
    text = "Total number of tables: 1\n----\nKeyspace : ks\n\tRead Count: 5\n\t\tTable: t1\n\t\tSpace used (total): 2 KB\n\t\tSSTables in each level: [1, 12/10]\n\t\tLocal read latency: NaN ms\nKeyspace : k2\n\tRead Count: 6"
    got = {(r.keyspace, r.table_name, r.attr): (r.num_value, r.str_value, r.uom) for r in T.read_table_stats(lines_of(spark, text)).collect()}
    assert got[("ks", None, "Read Count")] == (5.0, None, "") and got[("k2", None, "Read Count")] == (6.0, None, "")
    assert got[("ks", "t1", "Space used (total)")] == (2 / 1024, None, "MiB")
    assert got[("ks", "t1", "SSTables in each level")][1] == "[1, 12/10]" and len(got) == 5


def test_pool_stats(spark):
    text = "Pool Name   Active   Pending   Completed   Blocked   All time blocked\nReadStage   1   2   300   4   5\nMessage type   Dropped\nREAD   7\nHINT   8   N/A   0.5   0.9   1.5"
    got = {r.attr: r.num_value for r in T.read_pool_stats(lines_of(spark, text)).collect()}
    assert got["Pool Name.ReadStage.Completed"] == 300.0 and got["Pool Name.ReadStage.All time blocked"] == 5.0 and got["READ.Dropped"] == 7.0


def test_ring_status_hosts_cluster(spark):
    ring = T.read_ring(lines_of(spark, "Datacenter: dc1\n==========\n10.0.0.1  rack1  Up  Normal  1.5 GB  33.3%  -9223372036854775808\n10.0.0.2  rack1  Down  Normal  20 MB  ?  5")).collect()
    assert [(r.dc, r.address, r.status, r.load_mib, int(r.token)) for r in sorted(ring, key=lambda r: r.address)] == [("dc1", "10.0.0.1", "Up", 1536.0, -(1 << 63)), ("dc1", "10.0.0.2", "Down", 20.0, 5)]
    status = T.read_status(lines_of(spark, "Datacenter: dc1\nUN  10.0.0.1  1.5 GB  256  33.3%  0a-1  rack1")).collect()
    assert [(r.address, r.status, r.tokens, r.rack) for r in status] == [("10.0.0.1", "Up", 256, "rack1")]
    assert [tuple(r) for r in T.read_hosts_map(lines_of(spark, "# c\n10.0.0.1 a b # x\n\n")).collect()] == [("10.0.0.1", "a"), ("10.0.0.1", "b")]
    got = T.read_describe_cluster(lines_of(spark, "Cluster Information:\n\tName: C 1\n\tSnitch: s.T\n\t\t86afa796-d883-3932-aa73-6b017cef0d19: [10.0.0.1, 10.0.0.2]")).collect()
    assert ("Schema version", "86afa796-d883-3932-aa73-6b017cef0d19", "10.0.0.2") in [tuple(r) for r in got] and ("Name", "C 1", None) in [tuple(r) for r in got]


def test_histogram_and_clock(spark):
    got = {r.attr: r.num_value for r in T.read_histograms(lines_of(spark, "Percentile  Read  Write\n   (micros) (micros)\n50%  1500.00  20.00\nMax  3000.00  40.00")).collect()}
    assert got == {"read.50%": 1.5, "write.50%": 0.02, "read.Max": 3.0, "write.Max": 0.04}
    got = {r.attr: r.num_value for r in T.read_clock_facts(lines_of(spark, "synchronised to NTP server at stratum 3\n   time correct to within 12 ms\n 10:00 up 2 days, load average: 0.5, 1.5, 2.5")).collect()}
    assert got == {"stratum": 3.0, "time correct to": 12.0, "load 1 min": 0.5, "load 5 min": 1.5, "load 15 min": 2.5}


def test_config_lines(spark):
    text = "# comment\ncluster_name: 'My Cluster'\nserver:\n  encryption:\n    enabled: false  # why\n  port: 7000\nseeds:\n  - class: A\n    parameters:\n      - list: 1,2\n  - class: B\ndirs:\n  - /a\n  - /b"
    got = {r.property: r.value for r in T.read_config_lines(lines_of(spark, text)).collect()}
    assert got == {"cluster_name": "My Cluster", "server.encryption.enabled": "false", "server.port": "7000", "seeds.0.class": "A", "seeds.0.parameters.0.list": "1,2", "seeds.1.class": "B", "dirs.0": "/a", "dirs.1": "/b"}


def test_json_and_history(spark, tmp_path):
    (tmp_path / "10.0.0.1").mkdir()
    (tmp_path / "10.0.0.1/f.json").write_text(json.dumps({"cpu": {"load": 0.5, "name": "x"}, "size": 3}))
    got = {r.attr: (r.num_value, r.str_value) for r in SJ.read_json_facts(spark, str(tmp_path / "10.0.0.1/f.json")).collect()}
    assert got == {"cpu.load": (0.5, None), "cpu.name": (None, "x"), "size": (3.0, None)}
    (tmp_path / "nodes.json").write_text(json.dumps({"n1": {"dc": "d", "os": {"name": "l"}}}))
    assert [tuple(r) for r in SJ.read_node_info(spark, str(tmp_path / "nodes.json"), {"dc": "$.dc", "os": "$.os.name"}).collect()] == [("n1", "d", "l")]
    df = spark.createDataFrame([(1,)], "x int")
    for run in ("a", "b", "b"):
        SJ.write_results({"t": df}, str(tmp_path / "out"), run)
    assert sorted(r.run_id for r in SJ.read_history(spark, str(tmp_path / "out"), "t").collect()) == ["a", "b"]


def test_insights_and_schema(spark, tmp_path):
    document = {"metadata": {"name": "schema", "timestamp": 1704067200000, "tags": {}}, "data": {"keyspaces": [{"name": "k", "tables": [{"name": "t", "id": "i", "compaction": "LCS", "columns": [{"name": "a", "type": "int", "kind": "partition_key", "position": 0}]}], "indexes": [{"name": "x", "table": "t"}], "views": []}]}}
    folder = tmp_path / "name=schema/day=2024-01-01"
    folder.mkdir(parents=True)
    (folder / "d.json").write_text(json.dumps(document))
    docs = SJ.read_insights(spark, str(tmp_path), SJ.SCHEMA_DOCUMENT, "schema", "2024-01-01")
    assert docs.first().ts == dt.datetime(2024, 1, 1)
    assert sorted((r.kind, r.name) for r in SJ.read_schema_objects(docs).collect()) == [("index", "x"), ("keyspace", "k"), ("table", "t")]
    assert [tuple(r) for r in SJ.read_schema_columns(docs).collect()] == [("k", "t", "a", "int", "partition_key", 0)]


def test_hosts_line_with_many_names(spark):
    line = "10.0.0.1 " + " ".join(f"h{k}" for k in range(250)) + " # end"
    got = T.read_hosts_map(spark.createDataFrame([(line,), ("# none",), ("10.0.0.2",)], "line string")).collect()
    assert sorted(r["name"] for r in got) == sorted(f"h{k}" for k in range(250)) and {r.address for r in got} == {"10.0.0.1"}


def test_headers_reach_over_blocks(spark, tmp_path):
    """A file that Spark reads in many pieces: each line has the header above it, however many blocks lie between."""
    rows = [x for k in range(40) for x in [f"Keyspace : ks{k}", "\tRead Count: 1", *[y for t in range(k % 3) for y in [f"\t\tTable: t{t}", *[f"\t\tattr {j}: {j} ms" for j in range(k * 3 % 50)]]]]]
    (tmp_path / "10.0.0.1").mkdir()
    (tmp_path / "10.0.0.1/cfstats").write_text("\n".join(rows))
    got = {}
    for size in ("64", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = T.read_lines(spark, str(tmp_path / "10.0.0.1/cfstats"))
            got[size] = sorted(map(str, T.read_table_stats(lines).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sum((1 + (k % 3) * (k * 3 % 50)) for k in range(40))
    assert got["64"] == got["128m"] and len(got["64"]) == want
