"""The driver's tables as this library's entities, in Spark and as SQL: events, files, statistics, configuration, rings."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_CLASSES, EVENT_TYPES, ORPHANED

#: Event classes and types that stand for the driver's five event types.
CLASS_OF = {"click": "Compaction", "error": "GC", "purchase": "MemtableFlush", "signup": "Repair", "view": "Tombstone"}
TYPE_OF = {"signup": "SessionBegin", "purchase": "SessionEnd"}
#: Property names of the analytics groups, numbered for the made-up values below.
PROPS = (
    "pending completed blocked all_time_blocked memtable_ops memtable_mib partition_mib tombstones live_cells eden_before eden_after old_before old_after survivor_before"
    " survivor_after occurrences longest_ms shortest_ms pending_tasks partitions batch_mib discarded cache_mib pause_ms flush_ops serialized_mib flushed_mib onheap_mib"
    " offheap_mib onheap_pct offheap_pct row_rate old_mib new_mib read_rate write_rate merge_before merge_after hint_rows max_mib free_mib required_mib dropped_internal"
    " dropped_cross_node latency_ms found_rows expired_docs found_ms expired_ms sync_mib sync_rate inconsistent_pct failed_pct partial_pct uncompleted_pct"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that all executors see: spark.checkpoint.dir, or a fresh local one where that is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or tempfile.mkdtemp(prefix="ringwatch-")).rstrip("/")


def us(column: str, name: str | None = None):
    """A time as microseconds since 1970, comparable across engines."""
    return F.unix_micros(column).alias(name or f"{column}_us")


def utc(column: str):
    """A time without a zone as UTC, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz")))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded and times as microseconds, for comparing engines."""
    out = [F.round(c, digits).alias(c) if k == "double" else F.unix_micros(c).alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes]
    return df.select(*out)


def _case(values: dict[str, int], default: int | str = "NULL") -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


CLASS_SQL = _case({k: EVENT_CLASSES[v] for k, v in CLASS_OF.items()})
TYPE_SQL = _case({k: EVENT_TYPES[v] for k, v in TYPE_OF.items()}, EVENT_TYPES["SingleInstance"])
VALUE_SQL = {name: f"CASE WHEN (k + {i}) % 7 = 0 THEN NULL ELSE CAST(((k * {i + 3} + {i}) % 101) - 10 AS DOUBLE) END" for i, name in enumerate(PROPS)}


def events(spark: SparkSession, sf_dir: str, props: tuple[str, ...] = ()) -> DataFrame:
    """Events of 8 nodes in 2 data centers; properties are made from the number k in the driver's props."""
    rows = table(spark, sf_dir, "events").withColumn("ts", utc("ts")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.select(
        "event_id", "ts", "user_id", "event_type", "k", (F.col("user_id") % 8).cast("string").alias("node_id"), (F.col("user_id") % 8 % 2).cast("string").alias("dc"), F.expr(CLASS_SQL).cast("long").alias("class"), F.expr(TYPE_SQL).cast("long").alias("type"),
        F.col("value").alias("duration_ms"), F.col("user_id").cast("string").alias("session_key"), F.concat(F.lit("ks"), (F.col("user_id") % 3).cast("string")).alias("keyspace"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("table_name"),
    )
    pairs = [x for p in props for x in (F.lit(p), F.expr(VALUE_SQL[p]).cast("string"))]
    return rows.withColumn("props", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())) if props else rows


EV = f"""ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k, (user_id % 8)::VARCHAR AS node_id, (user_id % 8 % 2)::VARCHAR AS dc,
 ({CLASS_SQL})::BIGINT AS class, ({TYPE_SQL})::BIGINT AS type, value AS duration_ms, user_id::VARCHAR AS session_key, 'ks' || (user_id % 3) AS keyspace, 't' || (user_id % 5) AS table_name FROM events)"""


def orphans(rows: DataFrame) -> DataFrame:
    """Every event whose k is a multiple of 11 as an orphan."""
    return rows.withColumn("class", F.when(F.col("k") % 11 == 0, F.col("class").bitwiseOR(F.lit(ORPHANED))).otherwise(F.col("class")))


def gc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type = 'error'")
    return rows.select("node_id", F.col("ts").alias("ts_begin"), F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("duration_ms") * 1000).cast("long")).alias("ts_end"), "duration_ms")


GC = EV + ", gc AS (SELECT node_id, us AS b, us + round(duration_ms * 1000)::BIGINT AS e, duration_ms AS d FROM ev WHERE event_type = 'error')"


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per node, part of its users and half day, with whole hours as range: one part on half of the nodes, three on
    the others, so that ranges are equal, overlap, touch and leave gaps."""
    rows = events(spark, sf_dir).withColumns({"half": F.floor(F.unix_micros("ts") / 43_200_000_000), "part": F.expr("case when user_id % 8 < 4 then 0 else user_id div 8 % 3 end")})
    rows = rows.groupBy("dc", "node_id", "half", "part").agg(F.date_trunc("hour", F.min("ts")).alias("used_min"), F.date_trunc("hour", F.max("ts")).alias("used_max"), F.count(F.lit(1)).alias("items"), F.sum("event_id").alias("size"))
    return rows.withColumns({"is_debug": F.lit(False), "path": F.concat_ws("/", "node_id", "half", "part")}).drop("half", "part")


LF = EV + """, lf AS (SELECT dc, node_id, min(us) // 3600000000 * 3600000000 AS a, max(us) // 3600000000 * 3600000000 AS z, count(*)::BIGINT AS items, sum(event_id)::BIGINT AS size, node_id || '/' || half || '/' || part AS path
 FROM (SELECT *, us // 43200000000 AS half, CASE WHEN user_id % 8 < 4 THEN 0 ELSE user_id // 8 % 3 END AS part FROM ev) GROUP BY dc, node_id, half, part)"""


def long_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statistics from line items: supplier as node, its nation as data center, part type and brand as table."""
    li, su, pa = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    rows = li.join(su, li["l_suppkey"] == su["s_suppkey"]).join(pa, li["l_partkey"] == pa["p_partkey"])
    stack = "stack(4, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount, 'tax', l_tax) as (attr, num_value)"
    return rows.select(F.col("s_nationkey").cast("string").alias("dc"), F.col("l_suppkey").cast("string").alias("node_id"), F.col("p_type").alias("keyspace"), F.col("p_brand").alias("table_name"), F.expr(stack))


ST = """base AS (SELECT s_nationkey::VARCHAR AS dc, l_suppkey::VARCHAR AS node_id, p_type AS keyspace, p_brand AS table_name, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
 st AS (SELECT dc, node_id, keyspace, table_name, 'quantity' AS attr, l_quantity AS num_value FROM base UNION ALL SELECT dc, node_id, keyspace, table_name, 'price', l_extendedprice FROM base
 UNION ALL SELECT dc, node_id, keyspace, table_name, 'discount', l_discount FROM base UNION ALL SELECT dc, node_id, keyspace, table_name, 'tax', l_tax FROM base)"""


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, writes and keys per node and table."""
    rows = long_stats(spark, sf_dir).groupBy("dc", "node_id", "keyspace", "table_name")
    pick = lambda a: F.sum(F.when(F.col("attr") == a, F.col("num_value")))
    return rows.agg(pick("quantity").alias("reads"), F.round(pick("price"), 2).alias("writes"), F.count_if(F.col("attr") == "tax").cast("double").alias("keys"))


TC = ST + ", tc AS (SELECT dc, node_id, keyspace, table_name, sum(l_quantity) AS reads, round(sum(l_extendedprice), 2) AS writes, count(*)::DOUBLE AS keys FROM base GROUP BY ALL)"


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as configuration lines: nation as node, region of it as data center, market segment as property."""
    cu, na = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = cu.join(na, cu["c_nationkey"] == na["n_nationkey"])
    return rows.select(F.col("n_regionkey").cast("string").alias("dc"), F.col("n_nationkey").cast("string").alias("node_id"), F.lit("yaml").alias("cfg_type"), F.col("c_mktsegment").alias("property"), F.floor(F.col("c_acctbal") / 1000).cast("string").alias("value"))


def config_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("dc"), F.col("n_nationkey").cast("string").alias("node_id"))


CF = """cf AS (SELECT n_regionkey::VARCHAR AS dc, n_nationkey::VARCHAR AS node_id, 'yaml' AS cfg_type, lower(c_mktsegment) AS property, floor(c_acctbal / 1000)::BIGINT::VARCHAR AS value FROM customer JOIN nation ON c_nationkey = n_nationkey),
 cn AS (SELECT n_regionkey::VARCHAR AS dc, n_nationkey::VARCHAR AS node_id FROM nation)"""


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring tokens spread over the 64-bit ring from customer keys."""
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.lit("dc1").alias("dc"), F.col("c_nationkey").cast("string").alias("node_id"), ((F.col("c_custkey") * 4_000_037 % 1_000_003 - 500_000) * 18_000_000_000_000).alias("token"))


RG = "rg AS (SELECT 'dc1' AS dc, c_nationkey::VARCHAR AS node_id, ((c_custkey * 4000037 % 1000003 - 500000) * 18000000000000)::BIGINT AS token FROM customer)"
