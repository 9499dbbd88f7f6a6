"""Queries that read the driver's tables rendered as tool outputs and documents, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import json as Js
from ..sources import logs as L
from ..sources import text as T
from . import driver as D
from .driver import EV, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _lines(rows: DataFrame, file: str, seq: str, *lines: Column) -> DataFrame:
    """A file of lines per value of `file`, in the order of `seq`; each row gives the lines in order."""
    rows = rows.select(F.col(file).cast("string").alias("node_id"), F.col(seq).cast("long").alias("_at"), F.posexplode(F.array(*lines)).alias("_nth", "line"))
    return rows.select("node_id", F.concat(F.lit("/n/"), "node_id").alias("path"), F.lit(0).alias("block"), (F.col("_at") * 100 + F.col("_nth")).alias("seq"), "line")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


_POOLS = "SELECT node_id, event_type, count(*)::BIGINT AS n, max(k) AS k FROM ev GROUP BY ALL"


@query("read_log_range", f"""WITH {EV} SELECT event_id, node_id, us // 1000 AS ms, 1 + event_id % 2 AS lines FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08 12:00:00'""")
def read_log_range(spark, d):
    """A log per node, written as a text file in the order of time, of which three and a half days are read."""
    rows = D.events(spark, d).select("node_id", "ts", "event_id")
    head = F.concat(F.lit("INFO  [t:1] "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" A.java:1 - event "), F.col("event_id").cast("string"))
    rows = rows.select("node_id", "ts", "event_id", F.when(F.col("event_id") % 2 == 1, F.concat(head, F.lit("\n  at x"))).otherwise(head).alias("value"))
    folder = f"{D.scratch(spark)}/logs-{uuid.uuid4().hex}"
    rows.repartition("node_id").sortWithinPartitions("node_id", "ts", "event_id").select("node_id", "value").write.partitionBy("node_id").text(folder)
    read = L.read_log_range(spark, folder, zone=spark.conf.get("spark.sql.session.timeZone"), node_pattern=r"node_id=(\w+)").filter((F.col("ts") >= F.timestamp_micros(F.lit(int(1704412800e6)))) & (F.col("ts") < F.timestamp_micros(F.lit(int(1704715200e6)))))
    records = L.assemble_log_records(read)
    return records.select(F.regexp_extract("line", "event ([0-9]+)$", 1).cast("long").alias("event_id"), "node_id", F.floor(F.unix_micros(F.regexp_replace(F.regexp_extract("line", r"\] (\S+ \S+)", 1), ",", ".").cast("timestamp")) / 1000).alias("ms"), (F.size("extra") + 1).cast("long").alias("lines"))


@query("read_pool_stats", f"""WITH {EV}, g AS ({_POOLS}), a AS (SELECT node_id, event_type AS e, unnest(['Active', 'Pending', 'Completed', 'Blocked', 'All time blocked', 'Dropped']) AS c, unnest([n, k, n + k, 0, 7, k]) AS v FROM g)
SELECT node_id, CASE c WHEN 'Dropped' THEN e || '_MSG.Dropped' ELSE 'Pool Name.' || e || ' Stage.' || c END AS attr, v::DOUBLE AS num_value FROM a""")
def read_pool_stats(spark, d):
    g = D.events(spark, d).groupBy("node_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).withColumn("at", F.xxhash64("event_type") % 1_000_000)
    lines = _lines(g, "node_id", "at", F.lit("Pool Name   Active   Pending"), _text("event_type", "= Stage    ", "n", "=    ", "k", "=   ", F.col("n") + F.col("k"), "=   0     7"), F.lit(""), _text("event_type", "=_MSG      ", "k"))
    return T.read_pool_stats(lines).select("node_id", "attr", "num_value")


@query("read_status", """SELECT 'dc' || s_nationkey AS dc, '10.0.' || (s_suppkey // 250) || '.' || (s_suppkey % 250) AS address, CASE WHEN s_suppkey % 7 = 0 THEN 'Down' ELSE 'Up' END AS status, 'N' AS state, round(s_suppkey / 1024.0, 4)::DOUBLE AS load_mib, 256 AS tokens,
CASE WHEN s_suppkey % 5 > 0 THEN round((s_suppkey % 90 + 0.5) / 100, 4)::DOUBLE END AS owns, 'rack' || (s_suppkey % 3) AS rack FROM supplier""")
def read_status(spark, d):
    rows = D.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    line = _text(F.when(k % 7 == 0, "DN").otherwise("UN"), "=  10.0.", F.floor(k / 250), "=.", k % 250, "=  ", k, "= KiB  256  ", F.when(k % 5 > 0, _text(k % 90, "=.5%")).otherwise("?"), "=  ", F.md5(k.cast("string").cast("binary")), "=  rack", k % 3)
    out = T.read_status(_lines(rows, "s_nationkey", "s_suppkey", _text("=Datacenter: dc", "s_nationkey"), F.lit("=========="), F.lit("--  Address  Load  Tokens"), line))
    return rounded(out.select("dc", "address", "status", "state", "load_mib", "tokens", "owns", "rack"))


@query("read_ring", """SELECT 'dc' || c_nationkey AS dc, '10.' || (c_custkey // 62500) || '.' || (c_custkey // 250 % 250) || '.' || (c_custkey % 250) AS address, 'r' || (c_custkey % 4) AS rack, 'Up' AS status, 'Normal' AS state, (c_custkey % 900 * 1024)::DOUBLE AS load_mib,
((c_custkey * 4000037 % 1000003 - 500000) * 18000000000000)::BIGINT AS token FROM customer""")
def read_ring(spark, d):
    k = F.col("c_custkey")
    line = _text("=10.", F.floor(k / 62500), "=.", F.floor(k / 250) % 250, "=.", k % 250, "=   r", k % 4, "=   Up     Normal  ", k % 900, "= GB   ?   ", (k * 4_000_037 % 1_000_003 - 500_000) * 18_000_000_000_000)
    out = T.read_ring(_lines(D.table(spark, d, "customer"), "c_nationkey", "c_custkey", F.lit(""), _text("=Datacenter: dc", "c_nationkey"), line))
    return rounded(out.select("dc", "address", "rack", "status", "state", "load_mib", F.col("token").cast("long").alias("token")))


@query("read_workload_ring", """SELECT CASE WHEN c_custkey % 4 = 0 THEN 'A0-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') END AS server_id, '10.' || (c_custkey // 62500) || '.' || (c_custkey // 250 % 250) || '.' || (c_custkey % 250) AS address, 'dc' || c_nationkey AS dc, ['Cassandra', 'Analytics', 'SearchAnalytics'][c_custkey % 3 + 1] AS workload,
CASE WHEN c_custkey % 3 = 1 THEN 'SM' END AS role, CASE c_custkey % 3 WHEN 0 THEN 'Cassandra' WHEN 1 THEN 'Analytics' ELSE 'Analytics,Search' END || CASE WHEN c_custkey % 5 = 0 THEN ',Graph' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ',MultiInstance' ELSE '' END AS kinds, CASE WHEN c_custkey % 7 = 0 THEN 'Down' ELSE 'Up' END AS status,
(c_custkey % 900 * 1024)::DOUBLE AS load_mib, CASE WHEN c_nationkey % 2 = 0 THEN 256 END AS tokens, CASE WHEN c_nationkey % 2 = 1 THEN c_custkey * 1000 END::BIGINT AS token, CASE WHEN c_nationkey % 2 = 0 THEN 0.9 END::DOUBLE AS health FROM customer""")
def read_workload_ring(spark, d):
    k, even = F.col("c_custkey"), F.col("c_nationkey") % 2 == 0
    work = F.when(k % 3 == 0, "Cassandra").when(k % 3 == 1, "Analytics(SM)").otherwise("SearchAnalytics")
    head = F.when(even, "Server ID  Address  DC  Rack  Workload  Graph  Status  State  Load  Owns  VNodes  Health [0,1]").otherwise("Address  DC  Rack  Workload  Graph  Status  State  Load  Owns  Token")
    line = _text(F.when(k % 4 == 0, _text("=A0-", F.lpad((k % 90).cast("string"), 2, "0"), "=  ")).otherwise(""), "=10.", F.floor(k / 62500), "=.", F.floor(k / 250) % 250, "=.", k % 250, "=  dc", "c_nationkey", "=  rack1  ", work, F.when(k % 5 == 0, "  yes").otherwise("  no"), F.when(k % 7 == 0, "  Down").otherwise("  Up"), "=  Normal  ", k % 900, "= GB  ?  ", F.when(even, "256   0.90").otherwise((k * 1000).cast("string")), "=  ")
    out = T.read_workload_ring(_lines(D.table(spark, d, "customer"), "c_nationkey", "c_custkey", head, line, F.lit("Note: you must specify a keyspace to get ownership information.")))
    return out.select("server_id", "address", "dc", "workload", "role", F.array_join("kinds", ",").alias("kinds"), "status", "load_mib", "tokens", F.col("token").cast("long").alias("token"), "health")


@query("read_hosts_map", """WITH h AS (SELECT '10.0.' || (c_custkey // 250) || '.' || (c_custkey % 250) AS address, c_custkey AS k FROM customer) SELECT address, 'host' || k AS name FROM h UNION ALL SELECT address, 'host' || k || '.local' FROM h WHERE k % 3 = 0""")
def read_hosts_map(spark, d):
    k = F.col("c_custkey")
    line = _text("=  10.0.", F.floor(k / 250), "=.", k % 250, "=\thost", k, F.when(k % 3 == 0, _text("=   host", k, "=.local")).otherwise(""), "= # customer")
    return T.read_hosts_map(_lines(D.table(spark, d, "customer"), "c_nationkey", "c_custkey", F.lit("# hosts"), F.lit(""), line))


@query("read_describe_cluster", """SELECT 'Schema version' AS attr, r || '' AS value, '10.0.0.' || n_nationkey AS node FROM (SELECT n_nationkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS r FROM (SELECT *, md5(n_regionkey::VARCHAR) AS m FROM nation))
UNION ALL SELECT 'Snitch', 'snitch ' || n_regionkey, NULL FROM (SELECT DISTINCT n_regionkey FROM nation)""")
def read_describe_cluster(spark, d):
    rows = D.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(_text("=10.0.0.", "n_nationkey"))), ", ").alias("nodes"))
    m = F.md5(F.col("n_regionkey").cast("string").cast("binary"))
    uuid = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))
    return T.read_describe_cluster(_lines(rows, "n_regionkey", "n_regionkey", F.lit("Cluster Information:"), _text("=\tSnitch: snitch ", "n_regionkey"), F.lit("\tSchema versions:"), _text("=\t\t", uuid, "=: [", "nodes", "=]")))


@query("read_histograms", f"""WITH {EV}, g AS (SELECT node_id, count(*) AS n, max(k) AS k FROM ev GROUP BY node_id), x AS (SELECT node_id, unnest(['read.50%', 'write.50%', 'range.50%', 'read.Max', 'write.Max', 'range.Max']) AS attr, unnest([n, k, n * 2, k * 3, n, 5]) AS v FROM g) SELECT node_id, attr, round(v::DOUBLE / 1000, 4) AS num_value, 'ms' AS uom FROM x""")
def read_histograms(spark, d):
    g = D.events(spark, d).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    lines = _lines(g, "node_id", "n", F.lit("Percentile  Read Latency  Write Latency  Range Latency"), _text("=50%   ", "n", "=.00   ", "k", "=.00   ", F.col("n") * 2, "=.00"), _text("=Max   ", F.col("k") * 3, "=.00   ", "n", "=.00   5.00"))
    return rounded(T.read_histograms(lines).drop("source"))


@query("read_clock_facts", """SELECT s_nationkey::VARCHAR AS node_id, unnest(['stratum', 'time correct to', 'load 1 min', 'load 5 min', 'load 15 min', 'version']) AS attr, unnest([s_suppkey % 9, s_suppkey % 50, s_suppkey % 7, s_suppkey % 11, s_suppkey % 13, NULL])::DOUBLE AS num_value,
unnest([NULL, NULL, NULL, NULL, NULL, '6.' || (s_suppkey % 8) || '.' || (s_suppkey % 10)]) AS str_value FROM supplier""")
def read_clock_facts(spark, d):
    k = F.col("s_suppkey")
    lines = [_text("=synchronised to NTP server at stratum ", k % 9), _text("=   time correct to within ", k % 50, "= ms"), _text("= 10:11:12 up 3 days, load average: ", k % 7, "=.00, ", k % 11, "=.00, ", k % 13, "=.00"), _text("=6.", k % 8, "=.", k % 10)]
    out = T.read_clock_facts(_lines(D.table(spark, d, "supplier"), "s_nationkey", "s_suppkey", *lines))
    return out.select("node_id", "attr", "num_value", "str_value")


@query("read_info", """SELECT s_nationkey::VARCHAR AS node_id, unnest(['ID', 'Load', 'Uptime (seconds)', 'Gossip active']) AS attr, unnest([NULL, s_suppkey % 90 * 1024, s_suppkey, NULL])::DOUBLE AS num_value, unnest(['n-' || s_suppkey, NULL, NULL, 'true']) AS str_value FROM supplier""")
def read_info(spark, d):
    k = F.col("s_suppkey")
    return rounded(T.read_info(_lines(D.table(spark, d, "supplier"), "s_nationkey", "s_suppkey", _text("=ID                : n-", k), _text("=Load : ", k % 90, "= GiB"), _text("=Uptime (seconds)  : ", k), F.lit("Gossip active  : true"))).select("node_id", "attr", "num_value", "str_value"))


@query("read_config_lines", """WITH c AS (SELECT c_nationkey::VARCHAR AS node_id, 'k' || c_custkey AS k, c_custkey AS n FROM customer) SELECT node_id, k || '.inner.mode' AS property, 'm' || (n % 5) AS value FROM c UNION ALL SELECT node_id, k || '.list.' || i, 'v' || (n + i) FROM c, range(2) t(i) UNION ALL SELECT node_id, k || '.size', (n % 100)::VARCHAR FROM c""")
def read_config_lines(spark, d):
    k = F.col("c_custkey")
    lines = [_text("=k", k, "=:"), F.lit("  inner:  # nested"), _text("=    mode: m", k % 5), F.lit("  list:"), _text("=    - v", k), _text("=    - v", k + 1), _text("=  size: ", k % 100)]
    return T.read_config_lines(_lines(D.table(spark, d, "customer"), "c_custkey", "c_custkey", *lines)).join(D.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("node_id"), F.col("c_nationkey").cast("string").alias("nation")), "node_id").select(F.col("nation").alias("node_id"), "property", "value")


@query("json_facts", """SELECT s_suppkey::VARCHAR AS node_id, unnest(['cpu.cores', 'disk.data.sda.fs.used', 'disk.data.sda.fs.kind', 'tags']) AS attr, unnest([s_suppkey % 64, s_suppkey * 1.5, NULL, NULL])::DOUBLE AS num_value, unnest([NULL, NULL, 'ext4', '["a","b"]']) AS str_value FROM supplier""")
def json_facts(spark, d):
    k = F.col("s_suppkey")
    document = _text('={"cpu":{"cores":', k % 64, '=},"disk":{"data":{"sda":{"fs":{"used":', k * F.lit(1.5), '=,"kind":"ext4"}}}},"tags":["a","b"]}')
    return Js.json_facts(D.table(spark, d, "supplier").select(k.cast("string").alias("node_id"), document.alias("v"))).drop("source")


@query("node_info", "SELECT s_suppkey::VARCHAR AS node_id, (s_suppkey % 8)::VARCHAR AS cores, 'dc' || s_nationkey AS dc FROM supplier")
def node_info(spark, d):
    rows = D.table(spark, d, "supplier").select(_text('={"', "s_suppkey", '=":{"num_procs":', F.col("s_suppkey") % 8, '=,"loc":{"dc":"dc', "s_nationkey", '="}}}').alias("value"))
    return Js.node_info(rows, {"cores": "$.num_procs", "dc": "$.loc.dc"})


_SCHEMA = "struct<name:string,replication:map<string,string>,tables:array<struct<name:string,id:string,compaction:string,columns:array<struct<name:string,type:string,kind:string,position:int>>>>,indexes:array<struct<name:string,table:string>>,views:array<struct<name:string,table:string>>>"


def _schema_documents(spark, d):
    """A document per part type: its parts as tables with a column each, every third with an index, every fifth with a view."""
    k = F.col("p_partkey")
    table = F.concat(F.lit("t"), k.cast("string"))
    other = lambda prefix: F.struct(F.concat(F.lit(prefix), table).alias("name"), table.alias("table"))
    column = F.struct(F.lit("id").alias("name"), F.col("p_brand").alias("type"), F.lit("partition_key").alias("kind"), F.lit(0).alias("position"))
    rows = D.table(spark, d, "part").groupBy("p_type").agg(
        F.collect_list(F.struct(table.alias("name"), k.cast("string").alias("id"), F.when(k % 2 == 0, "STCS").otherwise("LCS").alias("compaction"), F.array(column).alias("columns"))).alias("tables"),
        F.collect_list(F.when(k % 3 == 0, other("i_"))).alias("indexes"), F.collect_list(F.when(k % 5 == 0, other("v_"))).alias("views"),
    )
    keyspace = F.struct(F.col("p_type").alias("name"), F.create_map(F.lit("dc1"), F.lit("3")).alias("replication"), "tables", "indexes", "views").cast(_SCHEMA)
    return rows.select(F.struct(F.array(keyspace).alias("keyspaces")).alias("data"))


@query("read_schema_objects", """SELECT DISTINCT p_type AS keyspace, p_type AS name, 'keyspace' AS kind, NULL AS base_table, NULL AS id, NULL AS compaction FROM part UNION ALL SELECT p_type, 't' || p_partkey, 'table', NULL, p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 'STCS' ELSE 'LCS' END FROM part
UNION ALL SELECT p_type, 'i_t' || p_partkey, 'index', 't' || p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_type, 'v_t' || p_partkey, 'view', 't' || p_partkey, NULL, NULL FROM part WHERE p_partkey % 5 = 0""")
def read_schema_objects(spark, d):
    return Js.read_schema_objects(_schema_documents(spark, d))


@query("read_schema_columns", "SELECT p_type AS keyspace, 't' || p_partkey AS table_name, 'id' AS name, p_brand AS cql_type, 'partition_key' AS kind, 0 AS position FROM part")
def read_schema_columns(spark, d):
    return Js.read_schema_columns(_schema_documents(spark, d))


@query("read_insights", "SELECT s_suppkey::VARCHAR AS node_id, (DATE '2024-01-01' + (s_suppkey % 3)::INTEGER)::VARCHAR AS day, s_suppkey * 1000000 AS us, s_acctbal AS value FROM supplier WHERE s_suppkey % 2 = 0")
def read_insights(spark, d):
    """Documents of two kinds and three days, written in their folders; one kind is read."""
    k = F.col("s_suppkey")
    metadata = F.struct(F.concat(F.lit("m"), (k % 2).cast("string")).alias("name"), (k * 1000).alias("timestamp"))
    rows = D.table(spark, d, "supplier").select(metadata.alias("metadata"), F.struct(k.cast("string").alias("node"), F.col("s_acctbal").alias("value")).alias("data"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 3).cast("int")).alias("day"))
    folder = f"{D.scratch(spark)}/insights-{uuid.uuid4().hex}"
    rows.write.partitionBy("name", "day").json(folder)
    read = Js.read_insights(spark, folder, "metadata struct<name:string,timestamp:bigint>, data struct<node:string,value:double>", "m0")
    return read.select(F.col("data.node").alias("node_id"), F.col("day").cast("string").alias("day"), F.unix_micros("ts").alias("us"), F.col("data.value").alias("value"))


@query("write_results", f"""WITH {EV}, g AS (SELECT us // 1800000000 * 1800000000 AS bucket, node_id, count(*)::BIGINT AS n, min(us) AS first_ts FROM ev GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY bucket, first_ts, node_id) AS place FROM g""")
def write_results(spark, d):
    """A result table written twice in the order of its rows and read again, with each row's place in the files."""
    rows = D.events(spark, d).groupBy((F.floor(F.unix_micros("ts") / 1_800_000_000) * 1_800_000_000).alias("bucket"), "node_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first_ts"))
    root = f"{D.scratch(spark)}/results-{uuid.uuid4().hex}"
    for run in ("r1", "r2", "r2"):
        Js.write_results({"log_aggregation": rows}, root, run, {"log_aggregation": ("bucket", "first_ts", "node_id")})
    read = Js.read_history(spark, root, "log_aggregation").filter("run_id = 'r2'").select("bucket", "node_id", "n", "first_ts", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    sizes = read.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("path", (F.sum("size").over(W.orderBy("path")) - F.col("size")).alias("before"))
    return read.join(before, "path").select("bucket", "node_id", "n", "first_ts", (F.col("before") + F.col("row") + 1).alias("place"))
