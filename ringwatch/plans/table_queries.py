"""Queries over statistics, schema, configuration, rings and text, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import wide as Wd
from ..operators import events as E
from ..operators import joins as J
from ..operators import stats as S
from ..operators import windows as Wn
from ..schema import EVENT_CLASSES, NODE_STATES
from ..sources import text as T
from . import driver as D
from . import flows
from .driver import CF, EV, LF, RG, ST, TC, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


MEASURES = {"reads": "quantity", "writes": "price"}
_NODE = ST + ", per AS (SELECT dc, node_id, sum(l_quantity) AS reads, sum(l_quantity) FILTER (keyspace <> 'ECONOMY') AS user_reads, sum(l_extendedprice) AS writes FROM base GROUP BY dc, node_id)"


@query("filter_keyspaces", f"""WITH {ST}, u AS (SELECT DISTINCT keyspace FROM st WHERE attr = 'tax' AND num_value > 0.079 AND node_id = '7')
SELECT CASE WHEN keyspace IN ('STANDARD', 'PROMO') THEN keyspace || ' (warn)' ELSE keyspace END AS keyspace, count(*)::BIGINT AS n FROM st WHERE keyspace <> 'ECONOMY' AND (keyspace NOT IN ('STANDARD', 'PROMO') OR keyspace IN (SELECT keyspace FROM u)) GROUP BY 1""")
def filter_keyspaces(spark, d):
    stats = D.long_stats(spark, d).withColumn("num_value", F.when((F.col("attr") != "tax") | ((F.col("num_value") > 0.079) & (F.col("node_id") == "7")), F.col("num_value")).otherwise(0.0))
    return E.filter_keyspaces(stats, ["ECONOMY"], ["STANDARD", "PROMO"], attr="tax").groupBy("keyspace").agg(F.count(F.lit(1)).alias("n"))


@query("datacenter_summary", f"""WITH {EV}, {_NODE}, n AS (SELECT s_nationkey::VARCHAR AS dc, count(*)::BIGINT AS nodes, count(*) FILTER (s_acctbal > 5000)::BIGINT AS nodes_up, count(*) FILTER (s_acctbal BETWEEN 0 AND 5000)::BIGINT AS nodes_down, count(*) FILTER (s_acctbal < 0)::BIGINT AS nodes_unknown,
 count(*) FILTER (s_suppkey % 3 = 0)::BIGINT AS cassandra_nodes, count(*) FILTER (s_suppkey % 3 = 1)::BIGINT AS search_nodes, count(*) FILTER (s_suppkey % 3 < 2 AND s_suppkey % 2 = 0)::BIGINT AS multiinstance_nodes, count(*) FILTER (s_suppkey % 3 = 2)::BIGINT AS other_nodes,
 max(u) AS data_used_pct_max, arg_max(s_suppkey::VARCHAR, (u, s_suppkey::VARCHAR)) FILTER (u IS NOT NULL) AS data_used_pct_max_node, min(u) AS data_used_pct_min, arg_min(s_suppkey::VARCHAR, (u, s_suppkey::VARCHAR)) FILTER (u IS NOT NULL) AS data_used_pct_min_node, round(avg(u), 2) AS data_used_pct_avg,
 CASE WHEN count(DISTINCT v) > 1 THEN 'MisMatched' ELSE max(v) END AS version, round(avg(s_suppkey % 50), 2) AS uptime_hours
 FROM (SELECT *, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 90)::DOUBLE END AS u, CASE WHEN s_nationkey % 2 = 0 THEN '6.8.1' WHEN s_suppkey % 2 = 0 THEN '6.8.2' ELSE '6.8.3' END AS v FROM supplier) GROUP BY 1),
c AS (SELECT (user_id % 25)::VARCHAR AS dc, count(*)::BIGINT AS events, count(*) FILTER (event_type = 'purchase' AND k % 2 = 0)::BIGINT AS flushes, count(*) FILTER (event_type = 'click' AND k % 2 = 0)::BIGINT AS compactions, count(*) FILTER (event_type = 'error')::BIGINT AS gcs, count(*) FILTER (event_type = 'signup')::BIGINT AS repairs,
 count(*) FILTER (event_type = 'signup' AND k % 2 = 0)::BIGINT AS starts, count(*) FILTER (event_type = 'signup' AND k % 2 <> 0)::BIGINT AS restarts, count(*) FILTER (event_type = 'error')::BIGINT AS long_pauses, count(*) FILTER (event_type = 'view')::BIGINT AS network_events FROM ev GROUP BY 1),
p AS (SELECT dc, round(max(reads), 2) AS reads_max, arg_max(node_id, (reads, node_id)) AS reads_max_node, round(min(reads), 2) AS reads_min, arg_min(node_id, (reads, node_id)) AS reads_min_node, round(avg(reads), 2) AS reads_avg, round(stddev_pop(reads), 2) AS reads_std, round(sum(reads), 2) AS reads_total, round(sum(reads) / (SELECT sum(reads) FROM per), 2) AS reads_pct, round(sum(user_reads) / sum(reads), 2) AS reads_user_pct, round(sum(writes), 2) AS writes_total FROM per GROUP BY dc)
SELECT n.*, events, flushes, compactions, gcs, repairs, starts, restarts, long_pauses, network_events, p.* EXCLUDE (dc) FROM n JOIN p USING (dc) JOIN c USING (dc)""")
def datacenter_summary(spark, d):
    k, balance = F.col("s_suppkey"), F.col("s_acctbal")
    kinds = F.array_compact(F.array(F.when(k % 3 == 0, "Cassandra"), F.when(k % 3 == 1, "Search"), F.when((k % 3 < 2) & (k % 2 == 0), "MultiInstance")))
    status = F.when(balance > 5000, "Up").when(balance >= 0, "Down")
    nodes = D.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("dc"), k.cast("string").alias("node_id"), status.alias("status"), kinds.alias("kinds"), F.when(k % 4 > 0, (k % 90).cast("double")).alias("data_used_pct"),
        F.when(F.col("s_nationkey") % 2 == 0, "6.8.1").when(k % 2 == 0, "6.8.2").otherwise("6.8.3").alias("version"), (k % 50).cast("double").alias("uptime_hours"))
    events = D.events(spark, d).withColumns({"dc": (F.col("user_id") % 25).cast("string"), "keyspace": F.when(F.col("k") % 2 == 0, F.col("keyspace"))})
    bit, kind = NODE_STATES, F.col("event_type")
    state = F.when((kind == "signup") & (F.col("k") % 2 == 0), bit["Started"]).when(kind == "signup", bit["Started"] | bit["Restarted"]).when(kind == "error", bit["Paused"] | bit["LongPause"]).when(kind == "view", bit["NetworkEvent"]).otherwise(0)
    out = S.datacenter_summary(nodes, D.long_stats(spark, d), events, MEASURES, F.col("keyspace") != "ECONOMY", states=events.select("dc", state.alias("state"))).filter("reads_max is not null and events is not null")
    columns = """dc nodes nodes_up nodes_down nodes_unknown cassandra_nodes search_nodes multiinstance_nodes other_nodes data_used_pct_max data_used_pct_max_node data_used_pct_min data_used_pct_min_node data_used_pct_avg version uptime_hours
    events flushes compactions gcs repairs starts restarts long_pauses network_events reads_max reads_max_node reads_min reads_min_node reads_avg reads_std reads_total reads_pct reads_user_pct writes_total""".split()
    return rounded(out.select(*columns), 2)


_SPECIAL = {"lwt": ("PROMO.Brand#1",), "batch": ("ECONOMY.Brand#2", "STANDARD.Brand#3"), "node_sync": ("SMALL.Brand#4", "LARGE.Brand#1")}


@query("special_writes", f"""WITH {ST}, x AS (SELECT dc, attr, num_value, keyspace || '.' || table_name AS t FROM (SELECT dc, attr, num_value, split_part(keyspace, ' ', 1) AS keyspace, substr(table_name, 1, 7) AS table_name FROM st))
SELECT dc, round(nullif(sum(num_value) FILTER (attr = 'price' AND t = 'PROMO.Brand#1'), 0) / sum(num_value) FILTER (attr = 'price'), 6) AS lwt_pct, round(nullif(sum(num_value) FILTER (attr = 'price' AND t IN ('ECONOMY.Brand#2', 'STANDARD.Brand#3')), 0) / sum(num_value) FILTER (attr = 'price'), 6) AS batch_pct,
round(nullif(sum(num_value) FILTER (attr IN ('price', 'quantity') AND t IN ('SMALL.Brand#4', 'LARGE.Brand#1')), 0), 2) AS node_sync_count, nullif(count(*) FILTER (attr = 'tax'), 0)::BIGINT AS no_space FROM x GROUP BY dc""")
def special_writes(spark, d):
    """The first words of keyspaces and tables, so that the special tables have rows."""
    stats = D.long_stats(spark, d).withColumns({"keyspace": F.substring_index("keyspace", " ", 1), "table_name": F.substring("table_name", 1, 7)})
    out = S.special_writes(stats, ["dc"], "quantity", "price", _SPECIAL, "tax")
    return out.select("dc", F.round("lwt_pct", 6).alias("lwt_pct"), F.round("batch_pct", 6).alias("batch_pct"), F.round("node_sync_count", 2).alias("node_sync_count"), "no_space")


@query("node_summary", f"""WITH {EV}, {_NODE}, c AS (SELECT (user_id % 100)::VARCHAR AS node_id, count(*)::BIGINT AS events, count(*) FILTER (event_type = 'purchase' AND k % 2 = 0)::BIGINT AS flushes, count(*) FILTER (event_type = 'click' AND k % 2 = 0)::BIGINT AS compactions, count(*) FILTER (event_type = 'error')::BIGINT AS gcs, count(*) FILTER (event_type = 'signup')::BIGINT AS repairs,
 count(*) FILTER (event_type = 'signup' AND k % 2 = 0)::BIGINT AS starts, count(*) FILTER (event_type = 'signup' AND k % 2 <> 0)::BIGINT AS restarts, count(*) FILTER (event_type = 'error')::BIGINT AS dead FROM ev GROUP BY 1)
SELECT per.dc, per.node_id, round(reads, 2) AS reads, round(user_reads, 2) AS user_reads, round(writes, 2) AS writes, round(reads / sum(reads) OVER (PARTITION BY per.dc), 2) AS reads_pct, events, flushes, compactions, gcs, repairs, starts, restarts, dead,
 CASE WHEN per.node_id::BIGINT % 3 > 0 THEN (per.node_id::BIGINT % 70)::DOUBLE END AS data_used_pct FROM (SELECT dc, node_id, reads, reads AS user_reads, writes FROM per) per LEFT JOIN c USING (node_id) QUALIFY events IS NOT NULL""")
def node_summary(spark, d):
    k, bit, kind = F.col("s_suppkey"), NODE_STATES, F.col("event_type")
    suppliers = D.table(spark, d, "supplier")
    nodes = suppliers.select(k.cast("string").alias("node_id"), F.col("s_nationkey").cast("string").alias("dc"), F.array(F.concat(F.lit("sd"), k.cast("string"))).alias("data_devices"))
    mounts = suppliers.filter(k % 3 > 0).select(k.cast("string").alias("node_id"), F.concat(F.lit("/dev/sd"), k.cast("string")).alias("mount"), (k % 70).cast("double").alias("used_pct"))
    events = D.events(spark, d).withColumns({"node_id": (F.col("user_id") % 100).cast("string"), "keyspace": F.when(F.col("k") % 2 == 0, F.col("keyspace"))})
    state = F.when((kind == "signup") & (F.col("k") % 2 == 0), bit["Started"]).when(kind == "signup", bit["Started"] | bit["Restarted"]).when(kind == "error", bit["Dead"]).otherwise(0)
    out = S.node_summary(nodes, D.long_stats(spark, d), events, measures=MEASURES, states=events.select("node_id", state.alias("state")), mounts=mounts).filter("reads is not null and events is not null")
    return rounded(out.select("dc", "node_id", "reads", "user_reads", "writes", "reads_pct", "events", "flushes", "compactions", "gcs", "repairs", "starts", "restarts", "dead", "data_used_pct"), 2)


@query("percent_of_total", f"WITH {TC} SELECT node_id, keyspace, table_name, round(reads / sum(reads) OVER (), 8) AS reads_pct, round(keys / sum(keys) OVER (), 8) AS keys_pct FROM tc")
def percent_of_total(spark, d):
    return rounded(S.percent_of_total(D.table_counts(spark, d), ["reads", "keys"]).select("node_id", "keyspace", "table_name", "reads_pct", "keys_pct"), 8)


_RULES = {
    "read_latency": {"trigger": 0.65, "attr": dict(threshold=49.0, factor=1.0, penalty=0.6), "min": dict(threshold=4.0, factor=0.25), "avg": dict(threshold=27.0, factor=0.5, penalty=0.1)},
    "write_latency": {"trigger": 0.65, "attr": dict(threshold=0.08, factor=1.0, penalty=0.0), "min": dict(threshold=0.01, factor=0.25), "avg": dict(threshold=0.04, factor=0.5, penalty=0.1)},
}
_ATTRS = {"read_latency": "quantity", "write_latency": "tax"}


def _over(v: str, t: float, f: float, p: float) -> str:
    full = f"{f}" if not p else f"(({v} / {t}) * {p} + {f})"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} / {t} < 1 THEN {f} * ({v} / {t}) ELSE {full} END"


def _tag_sql(keys: str) -> str:
    part, weights = [], {}
    for name, attr in _ATTRS.items():
        v, r = f"CASE WHEN attr = '{attr}' THEN num_value END", _RULES[name]
        part += [f"count({v}) AS {name}_n", f"max({v}) AS {name}_h", f"min({v}) AS {name}_l", f"avg({v}) AS {name}_m"]
        of = lambda c, k, r=r, name=name: "(" + _over(f"{name}_{c}", r[k]["threshold"], r[k]["factor"], r[k].get("penalty", 0)) + ")"
        weights[name] = f"CASE WHEN {name}_n > 0 THEN CASE WHEN {name}_h = {name}_l AND {name}_l = {name}_m THEN {of('m', 'attr')} ELSE {of('h', 'attr')} + {of('l', 'min')} + {of('m', 'avg')} END END"
    return f"g AS (SELECT {keys}, {', '.join(part)} FROM st GROUP BY {keys}), tg AS (SELECT *, {', '.join(f'{w} AS {n}_weight' for n, w in weights.items())} FROM g)"


@query("tagged_tables_node", f"""WITH {ST}, {_tag_sql("dc, keyspace, table_name, node_id")} SELECT dc, keyspace, table_name, node_id, round(read_latency_h, 4) AS read_latency_max, CASE WHEN read_latency_n = 1 THEN -1.0 ELSE round(read_latency_m, 4) END AS read_latency_avg,
round(read_latency_weight, 4) AS read_latency_weight, round(write_latency_weight, 4) AS write_latency_weight, coalesce(read_latency_weight >= 0.65, false) OR coalesce(write_latency_weight >= 0.65, false) AS flagged,
round(greatest(CASE WHEN read_latency_weight > 0 THEN read_latency_weight END, CASE WHEN write_latency_weight > 0 THEN write_latency_weight END), 4) AS weight_max FROM tg""")
def tagged_tables_node(spark, d):
    out = S.tagged_tables_node(D.long_stats(spark, d), _ATTRS, _RULES)
    return rounded(out.select("dc", "keyspace", "table_name", "node_id", "read_latency_max", "read_latency_avg", "read_latency_weight", "write_latency_weight", "flagged", "weight_max"))


@query("tagged_tables_dc", ORACLE_SQL["tagged_tables_node"].replace("dc, keyspace, table_name, node_id", "dc, keyspace, table_name"))
def tagged_tables_dc(spark, d):
    out = S.tagged_tables_dc(D.long_stats(spark, d), _ATTRS, _RULES)
    return rounded(out.select("dc", "keyspace", "table_name", "read_latency_max", "read_latency_avg", "read_latency_weight", "write_latency_weight", "flagged", "weight_max"))


@query("tagged_rollup", f"""WITH {ST}, {_tag_sql("dc, keyspace, table_name, node_id")} SELECT keyspace, table_name, round((sum(w) + max(w)) / (count(w) + 1), 4) AS factor, round(max(w), 4) AS factor_max, round(sum(w), 2) AS factor_sum, count(w)::BIGINT AS n
FROM (SELECT *, read_latency_weight AS w FROM tg) GROUP BY keyspace, table_name HAVING max(w) >= 0.9""")
def tagged_rollup(spark, d):
    out = S.tagged_rollup(S.tagged_tables(D.long_stats(spark, d), _ATTRS, rules=_RULES), "read_latency")
    return out.select("keyspace", "table_name", F.round("factor", 4).alias("factor"), F.round("factor_max", 4).alias("factor_max"), F.round("factor_sum", 2).alias("factor_sum"), "n")


@query("flagged_tables", f"""WITH {ST}, {_tag_sql("dc, keyspace, table_name, node_id")} SELECT keyspace, table_name, count(*)::BIGINT AS n FROM tg WHERE (keyspace, table_name) IN (SELECT (keyspace, table_name) FROM tg WHERE read_latency_weight >= 1.95) GROUP BY ALL""")
def flagged_tables(spark, d):
    rows = S.tagged_tables(D.long_stats(spark, d), _ATTRS, rules=_RULES)
    return J.flagged_tables_semi(rows, F.col("read_latency_weight") >= 1.95).groupBy("keyspace", "table_name").agg(F.count(F.lit(1)).alias("n"))


@query("threshold_weights", f"""WITH {EV} SELECT event_id, round({_over("duration_ms", 15.0, 0.25, 0.5)}, 4) AS over_weight, round(CASE WHEN duration_ms / 15 > 1 THEN 0.25 * duration_ms / 15 ELSE 0.25 END, 4) AS under_weight,
round(CASE WHEN duration_ms > 15 THEN 0.25 * duration_ms / 15 ELSE (duration_ms / 15 * 0.5 + 0.25) END, 4) AS raw_weight FROM ev""")
def threshold_weights(spark, d):
    w = lambda kind, p: F.round(C.threshold_weight(F.col("duration_ms"), F.lit(15.0), F.lit(1.0), F.lit(0.25), F.lit(p), F.lit(kind)), 4)
    return D.events(spark, d).select("event_id", w("over", 0.5).alias("over_weight"), w("under", 0.0).alias("under_weight"), w("raw over", 0.5).alias("raw_weight"))


@query("common_partition_keys", "WITH k AS (SELECT p_partkey::VARCHAR AS table_name, 'type ' || p_type || ', size ' || p_size AS partition_key FROM part), n AS (SELECT partition_key, count(*)::BIGINT AS tables FROM k GROUP BY ALL HAVING count(*) > 1) SELECT table_name, partition_key, tables FROM k JOIN n USING (partition_key)")
def common_partition_keys(spark, d):
    part = lambda pos, name, value: F.struct(F.lit(pos).alias("position"), F.lit(name).alias("name"), F.col(value).cast("string").alias("cql_type"))
    rows = D.table(spark, d, "part").select(F.lit("ks").alias("keyspace"), F.col("p_partkey").cast("string").alias("table_name"), F.lit("partition_key").alias("kind"), F.explode(F.array(part(1, "size", "p_size"), part(0, "type", "p_type"))).alias("c"))
    return S.common_partition_keys(rows.select("keyspace", "table_name", "kind", "c.*")).select("table_name", "partition_key", "tables")


_CK = TC + """, ky AS (SELECT DISTINCT keyspace, table_name, keyspace AS partition_key FROM tc), cs AS (SELECT keyspace, table_name, dc, sum(reads) AS reads, sum(writes) AS writes, sum(keys) AS keys, stddev_pop(reads) AS rs, stddev_pop(writes) AS ws, stddev_pop(keys) AS ks FROM tc GROUP BY ALL),
cf AS (SELECT partition_key, cs.* FROM cs JOIN ky USING (keyspace, table_name))"""


def _common(spark, d):
    rows = D.table_counts(spark, d)
    keys = rows.select("keyspace", "table_name").distinct().withColumn("partition_key", F.col("keyspace"))
    return S.common_key_stats(keys, rows, {"attr": dict(threshold=100_000.0, factor=1.0, penalty=0.0)})


@query("common_key_stats", f"WITH {_CK} SELECT partition_key, table_name, dc, round(reads, 2) AS reads, round(writes, 2) AS writes, round(rs, 2) AS reads_std, round({_over('((rs + ws + ks) / 3)', 100000.0, 1.0, 0.0)}, 4) AS factor FROM cf")
def common_key_stats(spark, d):
    return _common(spark, d).select("partition_key", "table_name", "dc", *[F.round(c, 2).alias(c) for c in ("reads", "writes", "reads_std")], F.round("factor", 4).alias("factor"))


@query("common_key_factors", f"""WITH {_CK}, m AS (SELECT partition_key, count(*)::BIGINT AS tables, max(rs) AS r, max(ws) AS w, max(ks) AS k FROM cf GROUP BY partition_key) SELECT partition_key, tables,
round((({_over("r", 500.0, 1.0, 0.0)}) + ({_over("w", 500.0, 1.0, 0.0)}) + ({_over("k", 500.0, 1.0, 0.0)})) / 3, 4) AS factor FROM m""")
def common_key_factors(spark, d):
    return rounded(S.common_key_factors(_common(spark, d), {"attr": dict(threshold=500.0, factor=1.0, penalty=0.0)}).select("partition_key", "tables", "factor"))


@query("attach_common_key", f"WITH {_CK} SELECT node_id, tc.keyspace, tc.table_name, round({_over('((rs + ws + ks) / 3)', 100000.0, 1.0, 0.0)}, 4) AS common_key_factor FROM tc LEFT JOIN cf ON cf.keyspace = tc.keyspace AND cf.table_name = tc.table_name AND cf.dc = tc.dc")
def attach_common_key(spark, d):
    return rounded(J.attach_common_key(D.table_counts(spark, d), _common(spark, d)).select("node_id", "keyspace", "table_name", "common_key_factor"))


@query("attach_base_table", f"WITH {TC} SELECT a.node_id, a.keyspace, a.table_name, b.reads AS base_reads FROM tc a LEFT JOIN tc b ON a.keyspace = b.keyspace AND a.node_id = b.node_id AND a.table_name IN ('Brand#1', 'Brand#2') AND b.table_name = 'Brand#3'")
def attach_base_table(spark, d):
    rows = D.table_counts(spark, d)
    objects = rows.filter("table_name in ('Brand#1', 'Brand#2')").select("keyspace", "table_name").distinct().withColumn("base_table", F.lit("Brand#3"))
    return J.attach_base_table(rows, objects, ["reads"]).select("node_id", "keyspace", "table_name", "base_reads")


@query("attach_dependents_count", """WITH o AS (SELECT p_type AS keyspace, p_brand AS base, CASE WHEN p_size % 3 = 0 THEN 'index' WHEN p_size % 3 = 1 THEN 'view' ELSE 'table' END AS kind FROM part), t AS (SELECT DISTINCT p_type AS keyspace, p_brand AS table_name FROM part)
SELECT t.keyspace, t.table_name, count(*) FILTER (kind = 'index')::BIGINT AS indexes, count(*) FILTER (kind = 'view')::BIGINT AS views FROM t LEFT JOIN o ON o.keyspace = t.keyspace AND o.base = t.table_name GROUP BY ALL""")
def attach_dependents_count(spark, d):
    part = D.table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "index").when(F.col("p_size") % 3 == 1, "view").otherwise("table")
    objects = part.select(F.col("p_type").alias("keyspace"), F.col("p_brand").alias("base_table"), kind.alias("kind"))
    return J.attach_dependents_count(part.select(F.col("p_type").alias("keyspace"), F.col("p_brand").alias("table_name")).distinct(), objects)


@query("keyspace_object_counts", """WITH o AS (SELECT p_type AS keyspace, CASE p_size % 7 WHEN 0 THEN 'index' WHEN 1 THEN 'view' WHEN 2 THEN 'type' WHEN 3 THEN 'function' WHEN 4 THEN 'trigger' ELSE 'table' END AS kind, ['STCS', 'LCS', 'DTCS', 'TCS', 'TWCS', 'UCS'][p_partkey % 6 + 1] AS c, p_retailprice > 950 AS a, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 11 - 1 END AS g, p_size % 4 = 0 AS cs, ['secondary', 'solr', 'sasi', 'custom'][p_partkey % 4 + 1] AS i FROM part)
SELECT keyspace, count(*) FILTER (kind = 'table')::BIGINT AS tables, count(*) FILTER (kind = 'view')::BIGINT AS views, count(*) FILTER (kind = 'index')::BIGINT AS indexs, count(*) FILTER (kind = 'type')::BIGINT AS types, count(*) FILTER (kind = 'function')::BIGINT AS functions, count(*) FILTER (kind = 'trigger')::BIGINT AS triggers,
count(*) FILTER (kind = 'index' AND i = 'secondary')::BIGINT AS secondary_indexes, count(*) FILTER (kind = 'index' AND i = 'solr')::BIGINT AS solr_indexes, count(*) FILTER (kind = 'index' AND i = 'sasi')::BIGINT AS sasi_indexes, count(*) FILTER (kind = 'index' AND i = 'custom')::BIGINT AS custom_indexes,
count(*) FILTER (kind = 'table' AND c = 'STCS')::BIGINT AS stcs, count(*) FILTER (kind = 'table' AND c = 'LCS')::BIGINT AS lcs, count(*) FILTER (kind = 'table' AND c = 'DTCS')::BIGINT AS dtcs, count(*) FILTER (kind = 'table' AND c = 'TCS')::BIGINT AS tcs, count(*) FILTER (kind = 'table' AND c = 'TWCS')::BIGINT AS twcs, count(*) FILTER (kind = 'table' AND c = 'UCS')::BIGINT AS other_strategies,
round(count(*) FILTER (a AND (kind IN ('table', 'view') OR (kind = 'index' AND i <> 'solr'))) / nullif(count(*) FILTER (kind IN ('table', 'view') OR (kind = 'index' AND i <> 'solr')), 0), 4) AS active_pct,
count(*)::BIGINT AS objects, count(*) FILTER (a AND (kind IN ('table', 'view') OR (kind = 'index' AND i <> 'solr')))::BIGINT AS active, max(g) FILTER (g >= 0) AS gc_grace_s_max, max(g * 2) FILTER (g >= 0) AS ttl_s_max, max(g / 10.0::DOUBLE) FILTER (g >= 0) AS read_repair_chance_max, count(*) FILTER (kind IN ('table', 'view') AND cs)::BIGINT AS compact_storage_tables FROM o GROUP BY keyspace""")
def keyspace_object_counts(spark, d):
    size, key = F.col("p_size") % 7, F.col("p_partkey")
    kind = F.when(size == 0, "index").when(size == 1, "view").when(size == 2, "type").when(size == 3, "function").when(size == 4, "trigger").otherwise("table")
    one = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    grace = F.when(key % 3 > 0, key % 11 - 1)
    return rounded(S.keyspace_object_counts(D.table(spark, d, "part").select(F.col("p_type").alias("keyspace"), kind.alias("kind"), one([*S.STRATEGIES, "UCS"]).alias("compaction"), (F.col("p_retailprice") > 950).alias("active"), one(S.INDEX_KINDS).alias("index_kind"),
        grace.alias("gc_grace_s"), (grace * 2).alias("ttl_s"), (grace / 10).alias("read_repair_chance"), (F.col("p_size") % 4 == 0).alias("compact_storage"))))


@query("column_feature_counts", """SELECT p_type AS keyspace, count(*)::BIGINT AS columns, count(*) FILTER (p_partkey % 8 IN (1, 2, 3))::BIGINT AS collections, count(*) FILTER (p_partkey % 8 IN (3, 4))::BIGINT AS blobs, count(*) FILTER (p_size % 5 = 0)::BIGINT AS static_columns,
count(*) FILTER (p_partkey % 8 IN (2, 5, 6))::BIGINT AS frozen, count(*) FILTER (p_partkey % 8 = 5)::BIGINT AS tuples, count(*) FILTER (p_partkey % 8 IN (2, 6))::BIGINT AS user_types FROM part GROUP BY p_type""")
def column_feature_counts(spark, d):
    types = ["int", "list<text>", "map<text, frozen<address>>", "set<blob>", "blob", "frozen<tuple<int, text>>", "frozen<Phone_2>", "'org.example.Custom'"]
    rows = D.table(spark, d, "part").select(F.col("p_type").alias("keyspace"), F.col("p_brand").alias("table_name"), F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, types)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("cql_type"), F.when(F.col("p_size") % 5 == 0, "static").otherwise("regular").alias("kind"))
    return S.column_feature_counts(rows)


@query("stat_value_occurrences", "SELECT s_nationkey::VARCHAR AS dc, l_suppkey::VARCHAR AS node_id, l_returnflag AS attr, l_linestatus AS str_value, count(*)::BIGINT AS num_value, 'Occurrences' AS uom FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def stat_value_occurrences(spark, d):
    li, su = D.table(spark, d, "lineitem"), D.table(spark, d, "supplier")
    rows = li.join(su, li["l_suppkey"] == su["s_suppkey"]).select(F.col("s_nationkey").cast("string").alias("dc"), F.col("l_suppkey").cast("string").alias("node_id"), F.lit("k").alias("keyspace"), F.lit("t").alias("table_name"), F.col("l_returnflag").alias("attr"), F.col("l_linestatus").alias("str_value"))
    return S.stat_value_occurrences(rows).select("dc", "node_id", "attr", "str_value", "num_value", "uom")


@query("pool_stats_wide", f"WITH {EV} SELECT node_id, event_type AS pool, round(sum(duration_ms), 4) AS active, count(*)::DOUBLE AS pending, round(max(duration_ms), 4) AS dropped FROM ev GROUP BY ALL")
def pool_stats_wide(spark, d):
    g = D.events(spark, d).groupBy("node_id", "event_type").agg(F.sum("duration_ms").alias("a"), F.count(F.lit(1)).cast("double").alias("p"), F.max("duration_ms").alias("x"))
    name = lambda c: F.concat(F.lit("Pool Name."), "event_type", F.lit("." + c))
    pairs = F.array(F.struct(name("Active").alias("attr"), F.col("a").alias("num_value")), F.struct(name("Pending").alias("attr"), F.col("p").alias("num_value")), F.struct(F.concat("event_type", F.lit(".Dropped")).alias("attr"), F.col("x").alias("num_value")))
    return rounded(S.pool_stats_wide(g.select("node_id", F.explode(pairs).alias("s")).select("node_id", "s.*")).select("node_id", "pool", "active", "pending", "dropped"))


_LCS = "'[' || (o_orderkey % 5)::VARCHAR || ', ' || (o_custkey % 30)::VARCHAR || CASE WHEN o_custkey % 30 > 10 THEN '/10' ELSE '' END || ', ' || (o_orderkey % 90)::VARCHAR || ']'"


def _lcs(spark, d):
    s = lambda c, n: (F.col(c) % n).cast("string")
    lcs = F.concat(F.lit("["), s("o_orderkey", 5), F.lit(", "), s("o_custkey", 30), F.when(F.col("o_custkey") % 30 > 10, "/10").otherwise(""), F.lit(", "), s("o_orderkey", 90), F.lit("]"))
    return D.table(spark, d, "orders").select(F.col("o_orderstatus").alias("keyspace"), F.col("o_orderpriority").alias("table_name"), F.col("o_orderkey").cast("string").alias("node_id"), lcs.alias("lcs"), "o_orderkey", "o_custkey", "o_totalprice")


@query("lcs_levels_report", f"""WITH o AS (SELECT o_orderstatus AS keyspace, o_orderpriority AS table_name, o_orderkey::VARCHAR AS node_id, {_LCS} AS lcs, o_orderkey % 5 AS a, o_custkey % 30 AS b, o_orderkey % 90 AS c FROM orders)
SELECT keyspace, table_name, node_id, lcs, b > 10 AS is_split, coalesce(CASE WHEN c > 0 THEN 2 WHEN b > 0 THEN 1 WHEN a > 0 THEN 0 END, -1)::INTEGER AS max_level, CASE WHEN b > 10 THEN 1 ELSE -1 END::INTEGER AS first_split, dense_rank() OVER (ORDER BY keyspace, table_name)::INTEGER AS group_no FROM o""")
def lcs_levels_report(spark, d):
    return S.lcs_levels_report(_lcs(spark, d)).fillna(-1, ["max_level", "first_split"])


@query("table_derived_ratios", """WITH o AS (SELECT o_orderkey, o_orderkey % 7 - 1 AS t, o_orderkey % 11 - 1 AS l, o_custkey % 5 - 1 AS r, o_custkey % 6 AS w, o_orderkey % 5 + o_custkey % 30 + o_orderkey % 90 AS actual, o_orderkey % 5 + CASE WHEN o_custkey % 30 > 10 THEN 10 ELSE o_custkey % 30 END + o_orderkey % 90 AS ideal FROM orders)
SELECT o_orderkey, round(CASE WHEN t >= 0 AND l >= 0 AND t + l > 0 THEN t / (t + l) END, 4) AS tombstone_ratio, round(CASE WHEN r >= 0 AND r + w > 0 THEN r / (r + w) END, 4) AS read_ratio, round(CASE WHEN ideal = 0 THEN 1.0 WHEN actual = 0 THEN 0.0 ELSE actual / ideal END, 4) AS lcs_ratio FROM o""")
def table_derived_ratios(spark, d):
    rows = _lcs(spark, d).withColumns({"tombstones": F.col("o_orderkey") % 7 - 1, "live_cells": F.col("o_orderkey") % 11 - 1, "reads": F.col("o_custkey") % 5 - 1, "writes": F.col("o_custkey") % 6})
    return rounded(S.table_derived_ratios(rows).select("o_orderkey", "tombstone_ratio", "read_ratio", "lcs_ratio"))


@query("table_totals_rollup", f"""WITH {TC} SELECT coalesce(node_id, '-') AS node_id, coalesce(keyspace, '-') AS keyspace, coalesce(table_name, '-') AS table_name, CASE grouping(table_name) + grouping(keyspace) WHEN 0 THEN 'table' WHEN 1 THEN 'keyspace' ELSE 'node' END AS level, round(sum(reads), 2) AS reads, round(sum(writes), 2) AS writes
FROM tc GROUP BY GROUPING SETS ((node_id, keyspace, table_name), (node_id, keyspace), (node_id))""")
def table_totals_rollup(spark, d):
    return rounded(S.table_totals_rollup(D.table_counts(spark, d), ["reads", "writes"]).fillna("-", ["keyspace", "table_name"]), 2)


@query("config_coverage", f"""WITH {CF}, s AS (SELECT dc, count(*) AS dn, count(*) FILTER (node_id NOT IN (SELECT node_id FROM cf)) AS wo FROM cn GROUP BY dc), v AS (SELECT dc, cfg_type, property, value, list_sort(list_distinct(list(node_id))) AS nodes FROM cf GROUP BY ALL),
r AS (SELECT v.*, len(nodes) AS n, count(*) OVER g AS vals, row_number() OVER (PARTITION BY dc, cfg_type, property ORDER BY len(nodes) DESC, value) AS nth, lead(len(nodes)) OVER (PARTITION BY dc, cfg_type, property ORDER BY len(nodes) DESC, value) AS nx FROM v WINDOW g AS (PARTITION BY dc, cfg_type, property))
SELECT r.dc, cfg_type, property, value, n::INTEGER AS n, CASE WHEN vals = 1 AND n = 1 THEN nodes[1] WHEN n = dn THEN 'all nodes' WHEN wo > 0 AND n = dn - wo THEN 'all nodes with configuration (' || n || ')' WHEN vals = 1 THEN 'partial (' || n || '): ' || array_to_string(nodes, ', ') WHEN nth = 1 AND n > nx THEN 'majority (' || n || ')' ELSE array_to_string(nodes, ', ') END AS label FROM r JOIN s USING (dc)""")
def config_coverage(spark, d):
    return S.config_coverage(D.config_lines(spark, d), D.config_nodes(spark, d))


@query("config_commonality", f"WITH {CF}, s AS (SELECT dc, count(*) AS dn FROM cn GROUP BY dc) SELECT cf.dc, property, value, count(DISTINCT node_id)::BIGINT AS n, CASE WHEN count(DISTINCT node_id) = any_value(dn) THEN 'all' WHEN count(DISTINCT node_id) >= 2 THEN 'some' ELSE 'one' END AS common FROM cf JOIN s USING (dc) GROUP BY cf.dc, property, value")
def config_commonality(spark, d):
    lines = D.config_lines(spark, d).withColumn("property", C.config_property(F.col("property")))
    return S.config_commonality(lines, D.config_nodes(spark, d)).select("dc", "property", "value", "n", "common")


@query("config_changes", """WITH n AS (SELECT c_nationkey::VARCHAR AS node_id, lower(c_mktsegment) AS p, min(lower(trim(floor(c_acctbal / 100)::BIGINT::VARCHAR))) AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL), o AS (SELECT c_nationkey::VARCHAR AS node_id, c_mktsegment AS property, floor(c_acctbal / 100)::BIGINT::VARCHAR AS v FROM customer WHERE c_custkey % 2 = 1)
SELECT DISTINCT o.node_id, property, o.v AS old_value, n.v AS new_value FROM o LEFT JOIN n ON n.node_id = o.node_id AND n.p = lower(o.property) WHERE o.v IS DISTINCT FROM n.v""")
def config_changes(spark, d):
    rows = D.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("node_id"), F.col("c_mktsegment").alias("property"), F.floor(F.col("c_acctbal") / 100).cast("string").alias("value"))
    seen = rows.filter("c_custkey % 2 = 1").select("node_id", F.lit(None).cast("timestamp").alias("ts"), F.create_map("property", "value").alias("props"))
    return J.config_changes(seen, rows.filter("c_custkey % 2 = 0")).select("node_id", "property", "old_value", "new_value")


@query("ring_to_ranges", f"WITH {RG} SELECT node_id, coalesce(lag(token) OVER (ORDER BY token), max(token) OVER ()) AS \"start\", token AS \"end\" FROM rg")
def ring_to_ranges(spark, d):
    return Wn.ring_to_ranges(D.ring(spark, d)).select("node_id", "start", "end")


@query("token_slots", f"""WITH {RG}, r AS (SELECT coalesce(lag(token) OVER (ORDER BY token), max(token) OVER ())::HUGEINT AS s, token::HUGEINT AS e FROM rg) SELECT e::BIGINT AS "end",
((CASE WHEN s = e THEN 18446744073709551615::HUGEINT WHEN (s > 0 AND e < 0) OR e < s THEN (e + 9223372036854775808::HUGEINT) + (9223372036854775807::HUGEINT - s) ELSE e - s END) // 1000)::BIGINT AS slots_k FROM r""")
def token_slots(spark, d):
    rows = Wn.ring_to_ranges(D.ring(spark, d))
    return rows.select("end", F.floor(C.token_slots(F.col("start"), F.col("end")) / 1000).cast("long").alias("slots_k"))


@query("tokens_containing", f"""WITH {RG}, r AS (SELECT node_id, coalesce(lag(token) OVER (ORDER BY token), max(token) OVER ()) AS s, token AS e FROM rg), t AS (SELECT o_orderkey, ((o_orderkey * 7000003 % 1000003 - 500000) * 18000000000001)::BIGINT AS token FROM orders)
SELECT o_orderkey, node_id, e AS "end" FROM t JOIN r ON (s < e AND token > s AND token <= e) OR (s >= e AND (token > s OR token <= e))""")
def tokens_containing(spark, d):
    tokens = D.table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7_000_003 % 1_000_003 - 500_000) * 18_000_000_000_001).alias("token"))
    return J.tokens_containing(tokens, Wn.ring_to_ranges(D.ring(spark, d))).select("o_orderkey", "node_id", "end")


_WIDE = f"""{RG}, r AS (SELECT node_id, coalesce(lag(token) OVER (ORDER BY token), max(token) OVER ()) AS a, token AS z FROM rg),
w AS (SELECT node_id, sign(a)::HUGEINT * (abs(a)::HUGEINT * 1000000000000000000::HUGEINT + 12345) AS s, sign(z)::HUGEINT * (abs(z)::HUGEINT * 1000000000000000000::HUGEINT + 12345) AS e FROM r)"""


def _wide_ring(spark, d):
    """The ring with eighteen more digits, that is 128-bit tokens in strings; the token 0 stays 0."""
    more = lambda c: F.when(F.col(c) == 0, "0").otherwise(F.concat(F.col(c).cast("string"), F.lit("000000000000012345")))
    return Wn.ring_to_ranges(D.ring(spark, d)).withColumns({"start": more("start"), "end": more("end")})


@query("wide_tokens_containing", f"""WITH {_WIDE}, t AS (SELECT o_orderkey, sign(t)::HUGEINT * (abs(t)::HUGEINT * 1000000000000000000::HUGEINT + 500000000000000000::HUGEINT) AS token FROM (SELECT o_orderkey, ((o_orderkey * 7000003 % 1000003 - 500000) * 18000000000001)::BIGINT AS t FROM orders) WHERE t <> 0)
SELECT o_orderkey, node_id, e::VARCHAR AS "end" FROM t JOIN w ON (s < e AND token > s AND token <= e) OR (s >= e AND (token > s OR token <= e))""")
def wide_tokens_containing(spark, d):
    tokens = D.table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7_000_003 % 1_000_003 - 500_000) * 18_000_000_000_001).alias("token")).filter("token <> 0")
    tokens = tokens.withColumn("token", F.concat(F.col("token").cast("string"), F.lit("500000000000000000")))
    return J.tokens_containing(tokens, _wide_ring(spark, d)).select("o_orderkey", "node_id", "end")


@query("wide_token_slots", f"""WITH {_WIDE} SELECT e::VARCHAR AS "end", CASE WHEN s < e THEN (e - s)::VARCHAR WHEN s = e THEN '170141183460469231731687303715884105727' ELSE (340282366920938463463374607431768211455::UHUGEINT - (s - e)::UHUGEINT)::VARCHAR END AS slots FROM w""")
def wide_token_slots(spark, d):
    rows = _wide_ring(spark, d).withColumns({"s": Wd.wide_token(F.col("start")), "e": Wd.wide_token(F.col("end"))})
    return rows.select(Wd.wide_text(F.col("e")).alias("end"), Wd.wide_text(Wd.wide_slots(F.col("s"), F.col("e"))).alias("slots"))


_CHECK = "CAST((o_orderkey * 7000003 % 1000003 - 500000) * 18000000000001 AS BIGINT)"


@query("ranges_containing", f"""WITH {RG}, r AS (SELECT node_id, coalesce(lag(token) OVER (ORDER BY token), max(token) OVER ()) AS s, token AS e FROM rg), t AS (SELECT o_orderkey, {_CHECK} AS a, {_CHECK} + o_orderkey % 9 * 1000000000000 AS z FROM orders)
SELECT o_orderkey, node_id, e AS "end" FROM t JOIN r ON CASE WHEN s < e THEN (z > s AND z <= e) OR (a > s AND a < e) ELSE z > s OR z <= e OR a > s OR a < e END""")
def ranges_containing(spark, d):
    checks = D.table(spark, d, "orders").select("o_orderkey", F.expr(_CHECK).alias("check_start"), F.expr(f"{_CHECK} + o_orderkey % 9 * 1000000000000").alias("check_end"))
    return J.ranges_containing(checks, Wn.ring_to_ranges(D.ring(spark, d))).select("o_orderkey", "node_id", "end")


@query("resolve_names", f"""WITH {ST}, t AS (SELECT DISTINCT keyspace, table_name FROM base), x AS (SELECT o_orderkey, o_orderkey % 3 AS m, 'PROMO.Brand#' || (o_orderkey % 40) AS b, 'PROMO' || '.by_Brand#' || (o_orderkey % 40) AS i FROM orders)
SELECT o_orderkey, t.keyspace AS keyspace_found, t.table_name AS table_found, CASE WHEN m > 0 AND t.keyspace IS NOT NULL THEN 'by_' || t.table_name END AS object_found FROM x LEFT JOIN t ON lower(CASE m WHEN 0 THEN b ELSE i END) = lower(CASE m WHEN 0 THEN t.keyspace || '.' || t.table_name ELSE t.keyspace || '.by_' || t.table_name END)""")
def resolve_names(spark, d):
    names = D.long_stats(spark, d).select("keyspace", "table_name").distinct().withColumn("id", F.lit(None).cast("string"))
    objects = names.select("keyspace", F.concat(F.lit("by_"), "table_name").alias("name"), F.lit("index").alias("kind"), F.col("table_name").alias("base_table"))
    k, brand = F.col("o_orderkey"), F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 40).cast("string"))
    raw = F.when(k % 3 == 0, F.concat(F.lit('"PROMO".'), brand)).when(k % 3 == 1, F.concat(F.lit("promo.BY_"), brand)).otherwise(F.concat(F.lit("PROMO."), brand, F.lit(".by_"), brand))
    return J.resolve_names(D.table(spark, d, "orders").select("o_orderkey", raw.alias("raw_name")), names, objects=objects).select("o_orderkey", "keyspace_found", "table_found", "object_found")


@query("resolve_nodes", "SELECT l_orderkey, l_linenumber, s_suppkey::VARCHAR AS node_found, s_nationkey::VARCHAR AS dc_found FROM lineitem LEFT JOIN supplier ON l_suppkey + 5 = s_suppkey")
def resolve_nodes(spark, d):
    hosts = D.table(spark, d, "supplier").select(F.concat(F.lit("HOST-"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").cast("string").alias("node_id"), F.col("s_nationkey").cast("string").alias("dc"))
    rows = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("host-"), (F.col("l_suppkey") + 5).cast("string")).alias("address"))
    return J.resolve_nodes(rows, hosts).select("l_orderkey", "l_linenumber", "node_found", "dc_found")


@query("unknown_nodes", "SELECT DISTINCT 'n' || (l_suppkey + 5) AS address FROM lineitem WHERE l_suppkey + 5 NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_nodes(spark, d):
    hosts = D.table(spark, d, "supplier").select(F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("name"))
    return J.unknown_nodes(D.table(spark, d, "lineitem").select(F.concat(F.lit("n"), (F.col("l_suppkey") + 5).cast("string")).alias("address")), hosts)


@query("keyspace_in_dc", f"WITH {ST}, r AS (SELECT DISTINCT dc, keyspace FROM base WHERE l_quantity > 49.5 AND table_name = 'Brand#1') SELECT DISTINCT dc, node_id, keyspace, 'keyspace ' || keyspace || ' isn''t replicated in ' || dc AS str_value FROM base WHERE (dc, keyspace) NOT IN (SELECT (dc, keyspace) FROM r)")
def keyspace_in_dc(spark, d):
    stats = D.long_stats(spark, d)
    return J.keyspace_in_dc(stats, stats.filter("attr = 'quantity' and num_value > 49.5 and table_name = 'Brand#1'")).select("dc", "node_id", "keyspace", "str_value")


@query("device_utilization", "WITH m AS (SELECT s_nationkey, min(s_acctbal) AS x, arg_min(s_acctbal, s_suppkey) AS u FROM supplier GROUP BY 1) SELECT n_nationkey::VARCHAR AS node_id, u AS data_used_pct, u AS commit_used_pct FROM nation LEFT JOIN m ON n_nationkey = s_nationkey")
def device_utilization(spark, d):
    mounts = D.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("node_id"), F.concat(F.lit("/mnt/"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit("/sda1")).alias("mount"), F.col("s_acctbal").alias("used_pct"))
    nodes = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node_id"), F.array(F.lit("sda"), F.lit("sdb")).alias("data_devices"), F.lit("sda1").alias("commit_device"))
    return J.device_utilization(nodes, mounts).select("node_id", "data_used_pct", "commit_used_pct")


_DQ = """w AS (SELECT s_nationkey::VARCHAR AS dc, s_suppkey::VARCHAR AS node_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey * 7 % 50)::DOUBLE END AS up, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE (s_suppkey * 5 % 40)::DOUBLE END AS sys, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey * 3 % 40)::DOUBLE END AS deb,
s_suppkey % 4 AS configs, s_suppkey % 5 > 0 AS ver, s_suppkey % 6 > 0 AS dev, (s_suppkey * 31 % 100)::DOUBLE AS reads, (s_suppkey * 17 % 90)::DOUBLE AS writes, s_suppkey % 3 AS starts, s_suppkey % 2 AS tc, s_suppkey % 10 > 0 AS need, s_suppkey % 11 > 0 AS heap, s_suppkey % 13 > 0 AS mem, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 1 END AS sst FROM supplier),
a AS (SELECT *, count(*) OVER g AS n, -2.0 / count(*) OVER g AS bad, abs(up - avg(up) OVER g) AS ou, stddev_pop(up) OVER g / sqrt(count(up) OVER g) AS eu, abs(sys - avg(sys) OVER g) AS os, stddev_pop(sys) OVER g / sqrt(count(sys) OVER g) AS es, abs(deb - avg(deb) OVER g) AS od, stddev_pop(deb) OVER g / sqrt(count(deb) OVER g) AS ed,
avg(reads) OVER g AS ar, avg(writes) OVER g AS aw FROM w WINDOW g AS (PARTITION BY dc)),
q AS (SELECT *, greatest(0.0, CASE WHEN up IS NULL THEN 0.0 WHEN ou <= 4 OR ou <= eu THEN 1.0 ELSE bad END + CASE WHEN sys IS NULL THEN -2.0 + bad WHEN os <= 4 OR os <= es THEN 1.0 ELSE bad END
+ CASE WHEN NOT need THEN 1.0 WHEN deb IS NULL THEN -1.0 + bad WHEN od <= 4 OR od <= ed THEN 1.0 ELSE bad END + CASE WHEN NOT need THEN 1.0 WHEN sys IS NULL OR deb IS NULL THEN 0.0 WHEN (abs(deb - sys) > 4 OR deb < 4 OR sys < 4) AND deb <> sys THEN -0.5 + bad ELSE 1.0 END
+ CASE WHEN abs(sys - up) <= 16 THEN 1.0 ELSE (-1.0 + bad) * CASE WHEN sys < up THEN (up - sys) / 16 ELSE 1.0 END END + CASE WHEN configs > 0 THEN 1 ELSE 0 END + CASE WHEN ver THEN 1 ELSE 0 END + CASE WHEN dev THEN 1 ELSE 0 END + CASE WHEN heap THEN 1 ELSE 0 END + CASE WHEN mem THEN 1 ELSE 0 END + CASE WHEN writes > 0 OR reads > 0 OR sst > 0 THEN 1 ELSE -1.5 END
+ CASE WHEN reads = 0 AND writes = 0 THEN 0.25 WHEN abs(reads - ar) <= ar * 0.15 THEN 0.5 ELSE 0.25 END + CASE WHEN reads = 0 AND writes = 0 THEN 0.25 WHEN abs(writes - aw) <= aw * 0.15 THEN 0.5 ELSE 0.25 END + starts * -0.1 + tc * -0.25) AS dq FROM a)"""


def _rated(spark, d):
    k = F.col("s_suppkey")
    hours = lambda skip, a, b: F.when(k % skip != 0, (k * a % b).cast("double"))
    nodes = D.table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("dc"), k.cast("string").alias("node_id"), hours(9, 7, 50).alias("uptime_hours"), hours(8, 5, 40).alias("system_hours"), hours(7, 3, 40).alias("debug_hours"), (k % 4).alias("configs"), (k % 5 > 0).alias("has_version"), (k % 6 > 0).alias("has_device"),
        (k % 11 > 0).alias("has_heap"), (k % 13 > 0).alias("has_memory"), (k * 31 % 100).cast("double").alias("reads"), (k * 17 % 90).cast("double").alias("writes"), F.when(k % 17 == 0, 0).otherwise(1).alias("sstables"), (k % 3).alias("starts"), (k % 2).alias("token_changes"), (k % 10 > 0).alias("debug_required"),
    )
    return S.data_quality_node(nodes)


@query("data_quality_node", f"WITH {_DQ} SELECT dc, node_id, round(dq, 4) AS dq_factor FROM q")
def data_quality_node(spark, d):
    return rounded(_rated(spark, d).select("dc", "node_id", "dq_factor"))


@query("data_quality_dc", f"""WITH {_DQ}, s AS (SELECT dc, count(*)::BIGINT AS nodes, sum(dq) AS dq, sum(CASE WHEN sys IS NULL THEN 0 ELSE 1 END) AS sf, sum(CASE WHEN deb IS NULL OR dc::INT % 4 = 0 THEN 0 ELSE 1 END) AS df, sum(reads * 40) AS e, sum(writes) AS g, sum(reads * 20) AS f, sum(reads * 15) AS c FROM q GROUP BY dc),
t AS (SELECT *, dq - CASE WHEN (sf > 0 OR df > 0) AND e < 10000 THEN (1 - e / 10000) * nodes ELSE 0 END - CASE WHEN sf > 0 AND g < 350 THEN (1 - g / 350) * nodes ELSE 0 END - CASE WHEN df > 0 AND f < 10000 THEN (1 - f / 10000) * nodes ELSE 0 END - CASE WHEN df > 0 AND c < 5000 THEN (1 - c / 5000) * nodes ELSE 0 END AS x,
CASE WHEN df > 0 THEN 0 ELSE 1 END + CASE WHEN sf > 0 THEN 0 ELSE 2 END + CASE WHEN df > 0 AND sf > 0 THEN 0 ELSE 1 END AS o, nodes * 3.0 AS q FROM s)
SELECT dc, nodes, round(x, 4) AS factor, (nodes * 12.0)::DOUBLE AS best, CASE WHEN x >= 4 * q - o THEN 'Excellent' WHEN x >= 3 * q - o THEN CASE WHEN x >= 3.5 * q - o AND 4 * q - o > 0 THEN 'Good+' ELSE 'Good' END WHEN x >= 2 * q - o THEN CASE WHEN x >= 2.5 * q - o AND 3 * q - o > 0 THEN 'OK+' ELSE 'OK' END WHEN x >= q - o THEN 'Poor' ELSE 'Poor-' END AS quality FROM t""")
def data_quality_dc(spark, d):
    rows = _rated(spark, d).withColumns({"system_files": F.col("system_hours").isNotNull().cast("int"), "debug_files": (F.col("debug_hours").isNotNull() & (F.col("dc").cast("int") % 4 != 0)).cast("int"), "events": F.col("reads") * 40, "gcs": F.col("writes"), "flushes": F.col("reads") * 20, "compactions": F.col("reads") * 15})
    return rounded(S.data_quality_dc(rows))


@query("normalize_units", """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_linenumber % 7 AS u FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_quantity * CASE u WHEN 0 THEN 1.0 / 1024 WHEN 1 THEN 1.0 WHEN 2 THEN 1024.0 WHEN 3 THEN 0.001 WHEN 4 THEN 60000.0 WHEN 5 THEN 0.01 ELSE 1024.0 END, 6) AS value,
CASE u WHEN 0 THEN 'MiB' WHEN 1 THEN 'MiB' WHEN 2 THEN 'MiB/sec' WHEN 3 THEN 'ms' WHEN 4 THEN 'ms' WHEN 5 THEN '%' ELSE 'MiB' END AS unit FROM x""")
def normalize_units(spark, d):
    units = F.array(*map(F.lit, (" KB", " MB", " GB/sec", " us", " min", "%", " GiB")))
    v = C.normalize_units(F.concat(F.format_string("%.2f", "l_quantity"), F.element_at(units, (F.col("l_linenumber") % 7 + 1).cast("int"))))
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(v["value"], 6).alias("value"), v["unit"].alias("unit"))


@query("sstable_to_table", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN lower(p_type) END AS keyspace, CASE WHEN p_size % 4 > 0 THEN replace(lower(p_brand), '#', '_') END AS table_name FROM part")
def sstable_to_table(spark, d):
    table, ks = F.regexp_replace(F.lower("p_brand"), "#", "_"), F.lower("p_type")
    path = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("/var/lib/data/"), ks, F.lit("/"), table, F.lit("-"), F.md5(F.col("p_name").cast("binary")), F.lit("/mc-"), F.col("p_size").cast("string"), F.lit("-big-Data.db"))).otherwise("/var/lib/data/x.log")
    v = C.sstable_to_table(path)
    return D.table(spark, d, "part").select("p_partkey", v["keyspace"].alias("keyspace"), v["table_name"].alias("table_name"))


@query("exception_paths", f"WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'IOException' WHEN k % 3 = 1 THEN 'RuntimeException=>TimeoutException' ELSE 'ExecutionException=>IOException' END AS path FROM ev WHERE event_type = 'error'")
def exception_paths(spark, d):
    text = F.when(F.col("k") % 3 == 0, "java.io.IOException: disk\n\tat a.b.C(D.java:1)\nCaused by: java.io.IOException: disk\n... 3 more").when(F.col("k") % 3 == 1, "java.lang.RuntimeException: x; nested exception is a.b.TimeoutException: late\n\tat a.B.c(B.java:2)").otherwise("java.util.concurrent.ExecutionException\n\tat x.y.Z(Z.java:9)\nCaused by: java.io.IOException: Broken pipe")
    return D.events(spark, d).filter("event_type = 'error'").select("event_id", C.exception_path_text(C.exception_path(text)).alias("path"))


def _log_lines(spark, d):
    """Events rendered as log text: a header line, and for every third event a continuation line."""
    rows = D.events(spark, d)
    level = F.when(F.col("event_type") == "error", "WARN ").otherwise("INFO ")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("ParNew GC in "), F.col("k").cast("string"), F.lit("ms. done"))).when(F.col("event_type") == "signup", F.concat(F.lit("Compacting (00-"), F.col("event_id").cast("string"), F.lit(") 4 sstables"))).when(F.col("event_type") == "view", F.concat(F.lit("Read 5 live rows and "), F.col("k").cast("string"), F.lit(" tombstone cells"))).otherwise(F.concat(F.lit("user "), "session_key"))
    head = F.concat(level, F.lit(" [T-"), "session_key", F.lit("] "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" Source.java:"), (F.col("event_id") % 900 + 1).cast("string"), F.lit(" - "), text)
    rows = rows.select("node_id", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(head, F.lit("\tat a.b.C(D.java:1)"))).otherwise(F.array(head))).alias("line"), "event_id")
    start = F.startswith(F.col("line"), F.lit("\t")).cast("long")
    return rows.select("node_id", F.concat(F.lit("/logs/"), "node_id", F.lit("/system.log")).alias("path"), F.lit(1).alias("size"), F.floor(F.col("event_id") / 1000).alias("block"), (F.col("event_id") * 2 + start).alias("seq"), (F.col("event_id") * 2 + start).alias("line_no"), "line")


@query("log_flow", f"""WITH {EV} SELECT node_id, CASE event_type WHEN 'error' THEN 'gc' WHEN 'signup' THEN 'compaction_begin' WHEN 'view' THEN 'tombstones' ELSE '-' END AS tag, count(*)::BIGINT AS n, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS extra, sum(CASE WHEN event_type = 'error' THEN k WHEN event_type = 'view' THEN k ELSE 0 END)::BIGINT AS total, min(us // 1000) AS first_ms FROM ev GROUP BY ALL""")
def log_flow(spark, d):
    rows = flows.log_flow(_log_lines(spark, d))
    number = F.coalesce(F.try_element_at("props", F.lit("pause_ms")), F.try_element_at("props", F.lit("tombstones")), F.lit("0")).cast("long")
    return rows.groupBy("node_id", F.coalesce("tag", F.lit("-")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("extra")).cast("long").alias("extra"), F.sum(number).alias("total"), F.min(F.unix_millis("ts")).alias("first_ms"))


@query("unhandled_events", f"WITH {EV} SELECT node_id, count(*)::BIGINT AS n, {EVENT_CLASSES['NotHandled']}::BIGINT AS class FROM ev WHERE event_type = 'error' GROUP BY node_id")
def unhandled_events(spark, d):
    lines = T.parse_header(T.assemble_records(_log_lines(spark, d)))
    return E.unhandled_events(E.classify_events(lines, [r for r in flows.RULES if r["tag"] != "gc"])).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.first("class").alias("class"))


@query("drop_duplicate_lines", f"WITH {EV} SELECT node_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT node_id, event_type, k FROM ev) GROUP BY node_id")
def drop_duplicate_lines(spark, d):
    rows = D.events(spark, d).select("node_id", F.lit("A.java").alias("src_file"), F.lit(1).alias("src_line"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", "k").alias("message"))
    return E.drop_duplicate_lines(rows).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("log_file_inventory", f"""WITH {EV}, m AS (SELECT node_id, event_type, lag(event_type) OVER (PARTITION BY node_id ORDER BY us, event_id) AS p FROM ev WHERE event_type IN ('purchase', 'signup')), r AS (SELECT node_id, count(*) FILTER (event_type = 'signup' AND p = 'purchase')::INTEGER AS restarts FROM m GROUP BY node_id)
SELECT node_id, min(us) AS file_min, max(us) AS file_max, count(*)::BIGINT AS items, any_value(restarts) AS restarts, false AS is_debug FROM ev JOIN r USING (node_id) GROUP BY node_id""")
def log_file_inventory(spark, d):
    rows = D.events(spark, d).withColumns({"path": F.concat(F.lit("/logs/"), "node_id", F.lit("/system.log")), "size": F.lit(1), "line_no": F.col("event_id"), "class_name": F.when(F.col("event_type") == "purchase", "Shutdown").when(F.col("event_type") == "signup", "NodeStart")})
    return rounded(T.log_file_inventory(rows).select("node_id", "file_min", "file_max", "items", F.size("restarts").alias("restarts"), "is_debug"))


@query("select_rules", "WITH r AS (SELECT p_partkey AS tag, p_size % 10 AS class, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 7 END AS v FROM part), n AS (SELECT DISTINCT n_nationkey % 6 AS version FROM nation), b AS (SELECT n.version, r.*, row_number() OVER (PARTITION BY n.version, class ORDER BY v DESC, tag) AS i FROM r JOIN n ON v <= n.version) SELECT version, tag FROM b WHERE i = 1 UNION ALL SELECT version, tag FROM r, n WHERE v IS NULL")
def select_rules(spark, d):
    rules = D.table(spark, d, "part").select(F.col("p_partkey").alias("tag"), (F.col("p_size") % 10).alias("class"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 7).alias("match_version"))
    return E.select_rules_for_version(rules, D.table(spark, d, "nation").select((F.col("n_nationkey") % 6).alias("version"))).select("version", "tag")


@query("read_table_stats", f"WITH {EV} SELECT node_id, 'ks' || (user_id % 3) AS keyspace, 't' || user_id AS table_name, round(sum(duration_ms), 2) AS reads, count(*)::DOUBLE * 2 / 1024 AS space_mib FROM ev GROUP BY ALL")
def read_table_stats(spark, d):
    g = D.events(spark, d).groupBy("node_id", "user_id").agg(F.sum("duration_ms").alias("a"), F.count(F.lit(1)).alias("n"))
    lines = F.array(F.concat(F.lit("Keyspace : ks"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("\t\tTable: t"), F.col("user_id").cast("string")), F.concat(F.lit("\t\tRead Count: "), F.format_string("%.2f", "a")), F.concat(F.lit("\t\tSpace used: "), (F.col("n") * 2).cast("string"), F.lit(" KB")), F.lit("\t\tState: fine"))
    text = g.select("node_id", F.concat(F.lit("/n/"), "node_id").alias("path"), F.lit(0).alias("block"), F.posexplode(lines).alias("i", "line"), "user_id").withColumn("seq", F.col("user_id") * 10 + F.col("i"))
    rows = T.read_table_stats(text)
    pick = lambda a, n: F.max(F.when(F.col("attr") == a, F.col("num_value"))).alias(n)
    return rows.groupBy("node_id", "keyspace", "table_name").agg(pick("Read Count", "reads"), pick("Space used", "space_mib"))


@query("fact_token_ranges", ORACLE_SQL["ring_to_ranges"].replace("SELECT node_id,", "SELECT 'dc1' AS dc, node_id,").replace("token AS \"end\"", "token AS \"end\", NULL::VARCHAR AS load_mib"))
def fact_token_ranges(spark, d):
    return S.fact_tables({"token_ranges": Wn.ring_to_ranges(D.ring(spark, d))})["token_ranges"].drop("slots")


@query("fact_table_stats", f"WITH {ST} SELECT dc, node_id, keyspace, table_name, attr, round(num_value, 4) AS num_value FROM st")
def fact_table_stats(spark, d):
    rows = S.fact_tables({"table_stats": D.long_stats(spark, d)})["table_stats"].drop("source", "str_value", "uom")
    return rounded(rows)


@query("fact_machines", "SELECT s_nationkey::VARCHAR AS dc, s_suppkey::VARCHAR AS node_id, 'os' || (s_suppkey % 3) AS os, s_suppkey % 64 AS cores, NULL::VARCHAR AS memory_mib, s_acctbal AS heap_mib, NULL::VARCHAR AS timezone FROM supplier")
def fact_machines(spark, d):
    """Machines whose documents say nothing of memory and time zone."""
    k = F.col("s_suppkey")
    rows = D.table(spark, d, "supplier").select(k.cast("string").alias("node_id"), F.col("s_nationkey").cast("string").alias("dc"), (k % 64).alias("cores"), F.concat(F.lit("os"), (k % 3).cast("string")).alias("os"), F.col("s_acctbal").alias("heap_mib"), F.col("s_name").alias("name"))
    return S.fact_tables({"machines": rows})["machines"]


@query("fact_log_files", f"WITH {LF} SELECT dc, node_id, path, false AS is_debug, a AS used_min, z AS used_max, NULL::VARCHAR AS size_mib, items FROM lf")
def fact_log_files(spark, d):
    return rounded(S.fact_tables({"log_files": D.log_files(spark, d)})["log_files"])


@query("fact_schema_objects", "SELECT p_type AS keyspace, p_name AS name, CASE WHEN p_size % 7 = 0 THEN 'view' ELSE 'table' END AS kind, CASE WHEN p_size % 7 = 0 THEN p_brand END AS base_table, NULL::VARCHAR AS compaction FROM part")
def fact_schema_objects(spark, d):
    view = F.col("p_size") % 7 == 0
    rows = D.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("keyspace"), F.when(view, "view").otherwise("table").alias("kind"), F.when(view, F.col("p_brand")).alias("base_table"))
    return S.fact_tables({"schema_objects": rows})["schema_objects"]


@query("multi_instance_nodes", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey % 2 = 0")
def multi_instance_nodes(spark, d):
    rows = D.table(spark, d, "supplier").withColumns({"multi_instance": F.col("s_acctbal") > 5000, "server_id": F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name"))})
    return S.multi_instance_nodes(rows).select("s_suppkey")
