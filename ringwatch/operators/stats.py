"""Aggregates over events, long-form statistics, schema objects and configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import THRESHOLDS, attr_weight, config_property, config_value_normalize, has_flag, lcs_parse, weigh
from ..schema import EVENT_CLASSES, INSTANCE_KINDS, NODE_STATES
from .joins import device_utilization


def with_one_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a one-row table, by an equi-join on a constant that broadcasts the one row."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _class(name: str) -> Column:
    return has_flag(F.col("class"), EVENT_CLASSES[name])


def event_counts(events: DataFrame, keys: Sequence[str], classes: Sequence[str] = ("MemtableFlush", "Compaction", "Repair")) -> DataFrame:
    """Flush, compaction and repair counts by key (keyspace, or keyspace and table) and their shares of the cluster's totals;
    a total of 0 gives 0. The totals are one row, joined by broadcast, so no key's rows meet in one task."""
    counts = [F.count_if(_class(c)).alias(c.lower()) for c in classes]
    rows, total = events.groupBy(*keys).agg(*counts), events.agg(*[c.alias(f"total_{k}") for c, k in zip([F.count_if(_class(c)) for c in classes], classes, strict=True)])
    rows = with_one_row(rows, total)
    share = [F.when(F.col(f"total_{c}") > 0, F.col(c.lower()) / F.col(f"total_{c}")).otherwise(0.0).alias(f"{c.lower()}_share") for c in classes]
    return rows.select(*keys, *[c.lower() for c in classes], *share)


def keyspace_event_counts(events: DataFrame) -> DataFrame:
    return event_counts(events.filter("keyspace is not null"), ["keyspace"])


def table_event_counts(events: DataFrame) -> DataFrame:
    return event_counts(events.filter("table_name is not null"), ["keyspace", "table_name"])


#: Attributes that the node and data-center summaries add up.
MEASURES = {"storage": "Space used (total)", "sstables": "SSTable count", "keys": "Number of partitions (estimate)", "reads": "Local read count", "writes": "Local write count"}


def node_measures(stats: DataFrame, measures: Mapping[str, str] = MEASURES, user: Column | None = None) -> DataFrame:
    """Long statistics of tables as one row per (dc, node): the sum of each measure, over all and over user keyspaces."""
    mine = F.lit(True) if user is None else user
    each = [e for k, a in measures.items() for e in (F.sum(F.when(F.col("attr") == a, F.col("num_value"))).alias(k), F.sum(F.when((F.col("attr") == a) & mine, F.col("num_value"))).alias(f"user_{k}"))]
    return stats.filter(F.col("attr").isin(*measures.values())).groupBy("dc", "node_id").agg(*each)


#: Tables whose writes tell lightweight transactions and batches, and whose reads and writes tell node syncs.
SPECIAL_TABLES = {"lwt": ("system.paxos",), "batch": ("system.batchlog", "system.batches"), "node_sync": ("system_distributed.nodesync_status", "system_distributed.nodesync_user_validations")}
#: Fixed value: the attribute of compactions that lacked space.
NO_SPACE = "Compaction Insufficient Space"


def special_writes(stats: DataFrame, keys: Sequence[str], reads: str = MEASURES["reads"], writes: str = MEASURES["writes"], tables: Mapping[str, Sequence[str]] = SPECIAL_TABLES, no_space: str = NO_SPACE) -> DataFrame:
    """Per key: the share of lightweight transactions and of batches in all writes (lwt_pct, batch_pct, null without any), the number of
    node syncs (node_sync_count, null without any), and of warnings that a compaction lacked space (no_space, null without any).

    stats (keys, keyspace, table_name, attr, num_value): they are told by the writes to system tables, node syncs by reads too."""
    attr, value = F.col("attr"), F.coalesce("num_value", F.lit(0.0))
    of = lambda kind, *attrs: F.sum(F.when(attr.isin(*attrs) & F.concat_ws(".", "keyspace", "table_name").isin(*tables[kind]), value))
    some = lambda c: F.when(c > 0, c)
    whole = F.sum(F.when(attr == writes, value))
    rows = stats.filter(attr.isin(reads, writes, no_space))
    return rows.groupBy(*keys).agg(F.try_divide(some(of("lwt", writes)), whole).alias("lwt_pct"), F.try_divide(some(of("batch", writes)), whole).alias("batch_pct"), some(of("node_sync", reads, writes)).alias("node_sync_count"), some(F.count_if((attr == no_space) & F.col("num_value").isNotNull())).alias("no_space"))


#: Counts of node states: a state counts where it has all bits of the first mask and none of the second.
STATE_COUNTS = {
    "starts": (NODE_STATES["Started"], NODE_STATES["Restarted"]), "restarts": (NODE_STATES["Restarted"], 0), "long_pauses": (NODE_STATES["LongPause"], 0),
    "not_responding": (NODE_STATES["NotResponding"], 0), "dead": (NODE_STATES["Dead"], 0), "network_events": (NODE_STATES["NetworkEvent"], 0),
}


def node_state_counts(states: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """State changes (keys, state) as counts of starts, restarts, long pauses, nodes not responding or dead and network events."""
    bits = F.col("state")
    each = [F.count_if((bits.bitwiseAND(F.lit(has)) == has) & (bits.bitwiseAND(F.lit(hasnt)) == 0)).alias(name) for name, (has, hasnt) in STATE_COUNTS.items()]
    return states.groupBy(*keys).agg(*each)


def datacenter_summary(nodes: DataFrame, stats: DataFrame, events: DataFrame, measures: Mapping[str, str] = MEASURES, user: Column | None = None, states: DataFrame | None = None) -> DataFrame:
    """Per data center: nodes, those up, down and unknown, event totals, and for each measure max, min, mean, standard
    deviation, total, its share of the cluster's, share of user keyspaces and the nodes with the extremes. Flush and compaction
    counts need a keyspace, GC and repair counts don't.

    nodes (dc, node_id, status) with `kinds`, an array, also give the number of nodes of each instance kind and of those
    without any; with data_used_pct the extremes and mean of the data devices and their nodes. states (dc, state) give the
    counts of node_state_counts. Nodes with `version` also give the version that all of them have, 'MisMatched' where they
    differ or, with `schema_version`, have different schemas; with `uptime_hours` its mean. stats with a table_name give the shares of
    special_writes. Equal extremes name the larger node for max, the smaller for min."""
    extremes = lambda c: [F.max(c).alias(f"{c}_max"), F.max_by("node_id", F.when(F.col(c).isNotNull(), F.struct(c, "node_id"))).alias(f"{c}_max_node"), F.min(c).alias(f"{c}_min"), F.min_by("node_id", F.when(F.col(c).isNotNull(), F.struct(c, "node_id"))).alias(f"{c}_min_node"), F.avg(c).alias(f"{c}_avg")]
    per = node_measures(stats, measures, user)
    each = [e for m in measures for e in (*extremes(m), F.stddev_pop(m).alias(f"{m}_std"), F.sum(m).alias(f"{m}_total"), F.try_divide(F.sum(f"user_{m}"), F.sum(m)).alias(f"{m}_user_pct"))]
    named = F.col("keyspace").isNotNull()
    counts = events.groupBy("dc").agg(F.count(F.lit(1)).alias("events"), F.count_if(_class("MemtableFlush") & named).alias("flushes"), F.count_if(_class("Compaction") & named).alias("compactions"), F.count_if(_class("GC")).alias("gcs"), F.count_if(_class("Repair")).alias("repairs"))
    up, down = F.col("status") == "Up", F.col("status") == "Down"
    facts = [F.count(F.lit(1)).alias("nodes"), F.count_if(up).alias("nodes_up"), F.count_if(down).alias("nodes_down"), F.count_if(~F.coalesce(up | down, F.lit(False))).alias("nodes_unknown")]
    if "kinds" in nodes.columns:
        has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
        facts += [F.count_if(has(k)).alias(f"{k.lower()}_nodes") for k in (*INSTANCE_KINDS, "MultiInstance")]
        facts.append(F.count_if(~(has(INSTANCE_KINDS[0]) | has(INSTANCE_KINDS[1]) | has(INSTANCE_KINDS[2]) | has(INSTANCE_KINDS[3]))).alias("other_nodes"))
    if "data_used_pct" in nodes.columns:
        facts += extremes("data_used_pct")
    if "version" in nodes.columns:
        differ = F.count_distinct("version") > 1
        if "schema_version" in nodes.columns:
            differ |= (F.count_distinct("schema_version") > 1) & (F.count("version") > 0)
        facts.append(F.when(differ, "MisMatched").otherwise(F.max("version")).alias("version"))
    if "uptime_hours" in nodes.columns:
        facts.append(F.avg("uptime_hours").alias("uptime_hours"))
    totals = with_one_row(per.groupBy("dc").agg(*each), per.agg(*[F.sum(m).alias(f"_whole_{m}") for m in measures]))
    totals = totals.select(*[c for c in totals.columns if not c.startswith("_whole_")], *[F.try_divide(F.col(f"{m}_total"), F.col(f"_whole_{m}")).alias(f"{m}_pct") for m in measures])
    out = nodes.groupBy("dc").agg(*facts).join(totals, "dc", "left").join(counts, "dc", "left")
    if "table_name" in stats.columns and {"reads", "writes"} <= set(measures):
        out = out.join(special_writes(stats, ["dc"], measures["reads"], measures["writes"]), "dc", "left")
    return out if states is None else out.join(node_state_counts(states, ["dc"]), "dc", "left").fillna(0, list(STATE_COUNTS))


def node_summary(nodes: DataFrame, stats: DataFrame, events: DataFrame, files: DataFrame | None = None, measures: Mapping[str, str] = MEASURES, states: DataFrame | None = None, mounts: DataFrame | None = None) -> DataFrame:
    """Per node: its facts, the sums of the measures and each one's share of the data center's, event totals, and the range and number
    of its log files. Flush and compaction counts need a keyspace, GC and repair counts don't.

    states (node_id, state) give the counts of node_state_counts; mounts (node_id, mount, used_pct) the utilisation of the
    node's devices, as device_utilization does; stats with a table_name the shares of special_writes."""
    named = F.col("keyspace").isNotNull()
    counts = events.groupBy("node_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(_class("MemtableFlush") & named).alias("flushes"), F.count_if(_class("Compaction") & named).alias("compactions"), F.count_if(_class("GC")).alias("gcs"), F.count_if(_class("Repair")).alias("repairs"))
    per = node_measures(stats, measures)
    whole = per.groupBy("dc").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    per = per.join(whole, "dc", "left").select("node_id", *[c for m in measures for c in (m, f"user_{m}")], *[F.try_divide(F.col(m), F.col(f"_{m}")).alias(f"{m}_pct") for m in measures])
    out = nodes.join(per, "node_id", "left").join(counts, "node_id", "left")
    if "table_name" in stats.columns and {"reads", "writes"} <= set(measures):
        out = out.join(special_writes(stats, ["node_id"], measures["reads"], measures["writes"]), "node_id", "left")
    if states is not None:
        out = out.join(node_state_counts(states), "node_id", "left").fillna(0, list(STATE_COUNTS))
    if mounts is not None:
        out = device_utilization(out, mounts)
    if files is not None:
        ranges = files.groupBy("node_id").agg(F.min("used_min").alias("log_min"), F.max("used_max").alias("log_max"), F.count(F.lit(1)).alias("log_files"))
        out = out.join(ranges, "node_id", "left")
    return out


def percent_of_total(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as a share of its total over all rows, as <column>_pct; a total of 0 gives 0."""
    total = rows.agg(*[F.sum(c).alias(f"_total_{c}") for c in columns])
    share = {f"{c}_pct": F.when(F.col(f"_total_{c}") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col(f"_total_{c}")).otherwise(0.0) for c in columns}
    return with_one_row(rows, total).withColumns(share).drop(*[f"_total_{c}" for c in columns])


def tagged_tables(stats: DataFrame, attrs: Mapping[str, str], keys: Sequence[str] = ("dc", "keyspace", "table_name", "node_id"), rules: Mapping[str, Mapping] = THRESHOLDS) -> DataFrame:
    """Long statistics as a row per table and node (or data center, by keys): for each weighed attribute its max, min, mean
    and standard deviation, its weight and flag, and whether any is flagged. With one value the min and mean read -1 and
    the deviation 0."""
    each = []
    for name, attr in attrs.items():
        v = F.when(F.col("attr") == attr, F.col("num_value"))
        each += [F.count(v).alias(f"{name}_n"), F.max(v).alias(f"{name}_max"), F.min(v).alias(f"{name}_min"), F.avg(v).alias(f"{name}_avg"), F.stddev_pop(v).alias(f"{name}_std")]
    rows = stats.filter(F.col("attr").isin(*attrs.values())).groupBy(*keys).agg(*each)
    for name in attrs:
        high, low, mean = (F.col(f"{name}_{k}") for k in ("max", "min", "avg"))
        weight = F.when(F.col(f"{name}_n") > 0, attr_weight(rules[name], high, low, mean))
        rows = rows.withColumns({f"{name}_weight": weight, f"{name}_flag": F.coalesce(weight >= rules[name]["trigger"], F.lit(False))})
        single = F.col(f"{name}_n") == 1
        rows = rows.withColumns({f"{name}_min": F.when(single, -1.0).otherwise(low), f"{name}_avg": F.when(single, -1.0).otherwise(mean)})
    weights = F.array_compact(F.array(*[F.when(F.col(f"{n}_weight") > 0, F.col(f"{n}_weight")) for n in attrs]))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    flag = F.lit(False)
    for n in attrs:
        flag |= F.col(f"{n}_flag")
    return rows.withColumns({"weight_max": F.array_max(weights), "weight_avg": F.when(F.size(weights) > 0, total / F.size(weights)), "flagged": flag}).drop(*[f"{n}_n" for n in attrs])


def tagged_tables_node(stats: DataFrame, attrs: Mapping[str, str], rules: Mapping[str, Mapping] = THRESHOLDS) -> DataFrame:
    return tagged_tables(stats, attrs, ("dc", "keyspace", "table_name", "node_id"), rules)


def tagged_tables_dc(stats: DataFrame, attrs: Mapping[str, str], rules: Mapping[str, Mapping] = THRESHOLDS) -> DataFrame:
    return tagged_tables(stats, attrs, ("dc", "keyspace", "table_name"), rules)


def tagged_rollup(tagged: DataFrame, name: str, trigger: float = 0.9, keys: Sequence[str] = ("keyspace", "table_name")) -> DataFrame:
    """An attribute's weights over nodes or data centers: (sum + max) / (n + 1), for tables with a weight of `trigger` or more."""
    w = F.col(f"{name}_weight")
    rows = tagged.groupBy(*keys).agg(((F.sum(w) + F.max(w)) / (F.count(w) + 1)).alias("factor"), F.max(w).alias("factor_max"), F.sum(w).alias("factor_sum"), F.count(w).alias("n"))
    return rows.filter(F.col("factor_max") >= trigger)


def common_partition_keys(columns: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Groups of two or more tables with the same partition key: names and types by position. columns (keyspace, table_name,
    name, cql_type, kind, position)."""
    rows = columns.filter(F.col("kind") == "partition_key")
    rows = rows.filter(~F.col("keyspace").isin(*ignore)) if ignore else rows
    part = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "cql_type"))), lambda x: F.concat_ws(" ", x["name"], x["cql_type"]))
    keys = rows.groupBy("keyspace", "table_name").agg(F.array_join(part, ", ").alias("partition_key"))
    counts = keys.groupBy("partition_key").agg(F.count(F.lit(1)).alias("tables")).filter("tables > 1")
    return keys.join(counts, "partition_key")


def common_key_stats(keys: DataFrame, stats: DataFrame, rules: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Per (partition key, table, dc): sums and population deviations of reads, writes and keys over nodes, and the factor:
    the weight of their mean deviation. stats (dc, keyspace, table_name, node_id, reads, writes, keys)."""
    rule = rules or {"attr": dict(threshold=1.0, factor=1.0, penalty=0.0)}
    per = stats.groupBy("keyspace", "table_name", "dc").agg(*[e for c in ("reads", "writes", "keys") for e in (F.sum(c).alias(c), F.stddev_pop(c).alias(f"{c}_std"))])
    spread = (F.col("reads_std") + F.col("writes_std") + F.col("keys_std")) / 3
    return keys.join(per, ["keyspace", "table_name"]).withColumn("factor", weigh(spread, rule["attr"]))


def common_key_factors(per_table: DataFrame, rules: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Per partition key: the mean over reads, writes and keys of the weight of the tables' deviations."""
    rule = rules or {"attr": dict(threshold=1.0, factor=1.0, penalty=0.0)}
    each = [attr_weight(rule, F.max(f"{c}_std"), F.min(f"{c}_std"), F.avg(f"{c}_std")) for c in ("reads", "writes", "keys")]
    return per_table.groupBy("partition_key").agg(((each[0] + each[1] + each[2]) / 3).alias("factor"), F.count(F.lit(1)).alias("tables"))


def log_coverage_node(gaps: DataFrame) -> DataFrame:
    """Per node and log kind: range, hours covered by Normal files, hours of gaps (their true length), and files."""
    length = (F.unix_micros("used_max") - F.unix_micros("used_min")) / 3600e6
    return gaps.groupBy("dc", "node_id", "is_debug").agg(
        F.min("used_min").alias("log_min"), F.max("used_max").alias("log_max"), F.sum(F.when(F.col("kind") == "Normal", length).otherwise(0.0)).alias("hours"),
        F.sum(F.when(F.col("kind") == "Gap", F.col("gap_minutes") / 60).otherwise(0.0)).alias("gap_hours"), F.count(F.lit(1)).alias("files"),
    )


def log_coverage_dc(coverage: DataFrame, uptime: DataFrame | None = None) -> DataFrame:
    """Per data center and log kind: mean and standard error (population deviation / square root of n) of the nodes' hours, sums of
    gaps and files; with uptime (dc, node_id, hours) the same of the nodes' uptime."""
    error = lambda c: F.stddev_pop(c) / F.sqrt(F.count(c))
    out = coverage.groupBy("dc", "is_debug").agg(F.avg("hours").alias("hours_avg"), error("hours").alias("hours_error"), F.sum("gap_hours").alias("gap_hours"), F.sum("files").alias("files"))
    if uptime is not None:
        out = out.join(uptime.groupBy("dc").agg(F.avg("hours").alias("uptime_avg"), error("hours").alias("uptime_error")), "dc", "left")
    return out


#: Fixed values of the data-quality factors.
NEAR_HOURS, UPTIME_HOURS, WITHIN = 4.0, 16.0, 0.15
MISSING_SYSTEM, MISSING_DEBUG, UNEQUAL_LOGS, LOG_BELOW_UPTIME, NO_COUNTS, PER_START, PER_TOKEN_CHANGE = -2.0, -1.0, -0.5, -1.0, -1.5, -0.1, -0.25
BEST = 12.0


def data_quality_node(nodes: DataFrame) -> DataFrame:
    """nodes with dq_factor: one point per good fact, less where it is missing or unlike the data center's.

    nodes (dc, node_id, uptime_hours, system_hours, debug_hours, configs, has_version, has_device, has_heap, has_memory, reads,
    writes, sstables, starts, token_changes, debug_required). A negative fact costs 2 / nodes of the data center; hours
    count as alike within 4 h or one standard error of the mean; the sum is not below 0, and at most 12.
    """
    dc = W.partitionBy("dc")
    count = F.count(F.lit(1)).over(dc)
    bad = F.lit(-2.0) / count

    def alike(c: str) -> Column:
        mean, error = F.avg(c).over(dc), F.stddev_pop(c).over(dc) / F.sqrt(F.count(c).over(dc))
        off = F.abs(F.col(c) - mean)
        return (off <= NEAR_HOURS) | (off <= error)

    def within(c: str) -> Column:
        mean = F.avg(c).over(dc)
        return F.when((F.col("reads") == 0) & (F.col("writes") == 0), 0.25).when(F.abs(F.col(c) - mean) <= mean * WITHIN, 0.5).otherwise(0.25)

    point = lambda ok: F.when(ok, 1.0).otherwise(0.0)
    up, sys, debug = F.col("uptime_hours"), F.col("system_hours"), F.col("debug_hours")
    unequal = ((F.abs(debug - sys) > NEAR_HOURS) | (debug < NEAR_HOURS) | (sys < NEAR_HOURS)) & (debug != sys)
    behind = F.when(up.isNotNull() & sys.isNotNull() & (sys < up), (up - sys) / UPTIME_HOURS).otherwise(1.0)
    need = F.col("debug_required")
    factor = (
        F.when(up.isNull(), 0.0).when(alike("uptime_hours"), 1.0).otherwise(bad)
        + F.when(sys.isNull(), MISSING_SYSTEM + bad).when(alike("system_hours"), 1.0).otherwise(bad)
        + F.when(~need, 1.0).when(debug.isNull(), MISSING_DEBUG + bad).when(alike("debug_hours"), 1.0).otherwise(bad)
        + F.when(~need, 1.0).when(sys.isNull() | debug.isNull(), 0.0).when(unequal, UNEQUAL_LOGS + bad).otherwise(1.0)
        + F.when(F.coalesce(F.abs(sys - up) <= UPTIME_HOURS, F.lit(False)), 1.0).otherwise((LOG_BELOW_UPTIME + bad) * behind)
        + point(F.col("configs") > 0) + point(F.col("has_version")) + point(F.col("has_device")) + point(F.col("has_heap")) + point(F.col("has_memory"))
        + F.when((F.col("writes") > 0) | (F.col("reads") > 0) | (F.col("sstables") > 0), 1.0).otherwise(NO_COUNTS)
        + within("reads") + within("writes") + F.col("starts") * PER_START + F.col("token_changes") * PER_TOKEN_CHANGE
    )
    return nodes.withColumn("dq_factor", F.greatest(F.lit(0.0), factor))


#: Events a data center should have for its logs to tell enough.
TARGETS = {"events": 10_000, "gcs": 350, "flushes": 10_000, "compactions": 5_000}


def data_quality_dc(rated: DataFrame) -> DataFrame:
    """Per data center the sum of its nodes' factors, less the shortfall of events against TARGETS, and its band.

    rated (dc, dq_factor, system_files, debug_files, events, gcs, flushes, compactions), a row per node. Bands are quarters of
    the best sum, moved down by missing log kinds: Poor, OK, Good, Excellent, '+' from half-way to the next, 'Poor-' below.
    """
    sums = rated.groupBy("dc").agg(F.count(F.lit(1)).alias("nodes"), *[F.sum(c).alias(c) for c in ("dq_factor", "system_files", "debug_files", *TARGETS)])
    system, debug = F.col("system_files") > 0, F.col("debug_files") > 0
    short = lambda c, when: F.when(when & (F.col(c) < TARGETS[c]), (1 - F.col(c) / TARGETS[c]) * F.col("nodes")).otherwise(0.0)
    factor = F.col("dq_factor") - short("events", system | debug) - short("gcs", system) - short("flushes", debug) - short("compactions", debug)
    offset = F.when(debug, 0).otherwise(1) + F.when(system, 0).otherwise(2) + F.when(system & debug, 0).otherwise(1)
    quarter = F.col("nodes") * BEST / 4
    bands = F.lit(None).cast("string")
    for k, name in enumerate(("Poor", "OK", "Good", "Excellent"), 1):
        line = k * quarter - offset
        plus = F.lit(False) if k in (1, 4) else (line + quarter > 0) & (factor >= line + quarter / 2)
        bands = F.when(factor >= line, F.when(plus, name + "+").otherwise(name)).otherwise(bands)
    return sums.select("dc", "nodes", factor.alias("factor"), (F.col("nodes") * BEST).alias("best"), F.coalesce(bands, F.lit("Poor-")).alias("quality"))


def config_coverage(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (dc, type, property, value): the nodes with the value and a label for how common it is.

    lines (dc, node_id, cfg_type, property, value), node_id null for the whole data center; nodes (dc, node_id)."""
    sizes = nodes.join(lines.filter("node_id is not null").select("dc", "node_id").distinct().withColumn("has", F.lit(1)), ["dc", "node_id"], "left")
    sizes = sizes.groupBy("dc").agg(F.count(F.lit(1)).alias("dc_nodes"), F.count_if(F.col("has").isNull()).alias("without"))
    whole = lines.filter("node_id is null").drop("node_id").join(nodes.select("dc", "node_id"), "dc")
    every = lines.filter("node_id is not null").unionByName(whole.select(*lines.columns))
    every = every.select("dc", "node_id", "cfg_type", config_property(F.col("property")).alias("property"), config_value_normalize(F.col("value")).alias("value"))
    values = every.groupBy("dc", "cfg_type", "property", "value").agg(F.array_sort(F.collect_set("node_id")).alias("nodes")).withColumn("n", F.size("nodes"))
    group = W.partitionBy("dc", "cfg_type", "property")
    order = group.orderBy(F.desc("n"), "value")
    rows = values.withColumns({"values": F.count(F.lit(1)).over(group), "nth": F.row_number().over(order), "next": F.lead("n").over(order)}).join(sizes, "dc")
    names, n = F.array_join("nodes", ", "), F.col("n").cast("string")
    label = (
        F.when((F.col("values") == 1) & (F.col("n") == 1), F.element_at("nodes", 1)).when(F.col("n") == F.col("dc_nodes"), F.lit("all nodes"))
        .when((F.col("without") > 0) & (F.col("n") == F.col("dc_nodes") - F.col("without")), F.concat(F.lit("all nodes with configuration ("), n, F.lit(")")))
        .when(F.col("values") == 1, F.concat(F.lit("partial ("), n, F.lit("): "), names)).when((F.col("nth") == 1) & (F.col("n") > F.col("next")), F.concat(F.lit("majority ("), n, F.lit(")"))).otherwise(names)
    )
    return rows.select("dc", "cfg_type", "property", "value", "n", label.alias("label"))


def config_commonality(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per configuration line of a data center: whether it is on all nodes, on some (2 or more) or on one."""
    sizes = nodes.groupBy("dc").agg(F.count_distinct("node_id").alias("dc_nodes"))
    n = lines.groupBy("dc", "cfg_type", "property", "value").agg(F.count_distinct("node_id").alias("n")).join(sizes, "dc")
    return n.withColumn("common", F.when(F.col("n") == F.col("dc_nodes"), "all").when(F.col("n") >= 2, "some").otherwise("one"))


def stat_value_occurrences(stats: DataFrame) -> DataFrame:
    """Text-valued statistics counted by node, attribute and value, with the unit Occurrences."""
    keys = ["dc", "node_id", "keyspace", "table_name", "attr", "str_value"]
    return stats.filter("str_value is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("num_value")).withColumn("uom", F.lit("Occurrences"))


POOL_COLUMNS = ("Active", "Pending", "Completed", "Blocked", "All time blocked", "Dropped", "Latency")


def pool_stats_wide(stats: DataFrame, columns: Sequence[str] = POOL_COLUMNS) -> DataFrame:
    """Pool statistics (node_id, attr 'Pool Name.<pool>.<column>' or '<message>.Dropped', num_value) as a row per pool."""
    parts = F.split(F.regexp_replace("attr", r"^Pool Name\.", ""), r"\.")
    rows = stats.select("node_id", F.element_at(parts, 1).alias("pool"), F.element_at(parts, -1).alias("measure"), "num_value")
    wide = [F.max(F.when(F.col("measure") == c, F.col("num_value"))).alias(c.lower().replace(" ", "_")) for c in columns]
    return rows.groupBy("node_id", "pool").agg(*wide)


#: Kinds of indexes by the class that serves them, and compaction strategies that are counted by name: fixed values.
INDEX_KINDS = ("secondary", "solr", "sasi", "custom")
STRATEGIES = ("STCS", "LCS", "DTCS", "TCS", "TWCS")
#: Column types that are built in, fixed values; a type of another name is a user's type.
CQL_TYPES = "ascii bigint blob boolean counter date decimal double duration float frozen inet int list map set smallint text time timestamp timeuuid tinyint tuple uuid varchar varint".split()


def keyspace_object_counts(objects: DataFrame) -> DataFrame:
    """Per keyspace: tables, views, indexes, types, functions, triggers, tables by compaction strategy, and the share of active
    objects. objects (keyspace, name, kind, compaction, active).

    With index_kind (INDEX_KINDS) also the indexes of each kind. The share is that of tables, views and indexes, search
    indexes (solr) left out; null without any. Of these columns each that is there gives its largest value: read_repair_chance,
    dc_read_repair_chance, gc_grace_s, ttl_s (negative ones and nulls are unknown); of order_by, compact_storage and node_sync,
    booleans, the number of tables and views that have it."""
    kind, plan = F.col("kind"), F.col("compaction")
    kinds = [F.count_if(kind == k).alias(f"{k}s") for k in ("table", "view", "index", "type", "function", "trigger")]
    plans = [F.count_if((kind == "table") & (plan == s)).alias(s.lower()) for s in STRATEGIES]
    plans.append(F.count_if((kind == "table") & ~plan.isin(*STRATEGIES)).alias("other_strategies"))
    stored = kind.isin("table", "view", "index")
    if "index_kind" in objects.columns:
        kinds += [F.count_if((kind == "index") & (F.col("index_kind") == k)).alias(f"{k}_indexes") for k in INDEX_KINDS]
        stored &= ~((kind == "index") & F.coalesce(F.col("index_kind") == "solr", F.lit(False)))
    active = F.try_divide(F.count_if(stored & F.col("active")), F.count_if(stored)).alias("active_pct")
    more = [F.max(F.when(F.col(c) >= 0, F.col(c))).alias(f"{c}_max") for c in ("read_repair_chance", "dc_read_repair_chance", "gc_grace_s", "ttl_s") if c in objects.columns]
    more += [F.count_if(kind.isin("table", "view") & F.col(c)).alias(f"{c}_tables") for c in ("order_by", "compact_storage", "node_sync") if c in objects.columns]
    total = F.count_if(kind.isin("table", "view", "index", "type", "function", "trigger")).alias("objects")
    return objects.groupBy("keyspace").agg(*kinds, *plans, total, F.count_if(stored & F.col("active")).alias("active"), active, *more)


def column_feature_counts(columns: DataFrame) -> DataFrame:
    """Per keyspace: columns, and those that are collections, blobs, static, frozen, tuples or of a user's type; a column counts
    for each that it has. columns (keyspace, table_name, name, cql_type, kind)."""
    cql = F.lower("cql_type")
    users = F.size(F.array_except(F.regexp_extract_all(F.regexp_replace(cql, "'[^']*'", ""), F.lit(r"([a-z_][a-z0-9_]*)")), F.array(*map(F.lit, CQL_TYPES)))) > 0
    has = {"collections": cql.rlike(r"\b(?:list|set|map)\s*<"), "blobs": cql.rlike(r"\bblob\b"), "static_columns": F.lower("kind") == "static", "frozen": cql.rlike(r"\bfrozen\s*<"), "tuples": cql.rlike(r"\btuple\s*<"), "user_types": users}
    return columns.groupBy("keyspace").agg(F.count(F.lit(1)).alias("columns"), *[F.count_if(v).alias(k) for k, v in has.items()])


def table_derived_ratios(wide: DataFrame) -> DataFrame:
    """Tables (..., tombstones, live_cells, reads, writes, lcs text) with tombstone, read, write and level ratios.

    -1 reads as missing; a ratio without a denominator is null; the level ratio is actual / ideal tables, 1 where ideal is 0
    and 0 where actual is."""
    known = lambda c: F.when(F.col(c) != -1, F.col(c))
    lcs = lcs_parse(F.col("lcs"))
    share = lambda a, b: F.try_divide(known(a), known(a) + known(b))
    level = F.when(lcs["ideal"] == 0, 1.0).when(lcs["actual"] == 0, 0.0).otherwise(lcs["actual"] / F.nullif(lcs["ideal"], F.lit(0)))
    return wide.withColumns({"tombstone_ratio": share("tombstones", "live_cells"), "read_ratio": share("reads", "writes"), "write_ratio": share("writes", "reads"), "lcs_ratio": level})


def table_totals_rollup(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of the columns at table, keyspace and node level in one pass; level says which."""
    out = rows.rollup("node_id", "keyspace", "table_name").agg(F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in columns])
    level = F.when(F.col("g") == 0, "table").when(F.col("g") == 1, "keyspace").when(F.col("g") == 3, "node")
    return out.withColumn("level", level).filter("level is not null").drop("g")


def lcs_levels_report(tables: DataFrame) -> DataFrame:
    """Per keyspace, table and node the level list, its split flag, maximum level, first split level, and a dense number of the
    (keyspace, table) group: its number in the keyspace after the count of groups in keyspaces before it."""
    groups = tables.select("keyspace", "table_name").distinct()
    sizes = groups.groupBy("keyspace").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("keyspace", (F.sum("n").over(W.orderBy("keyspace")) - F.col("n")).alias("before"))
    groups = groups.withColumn("nth", F.row_number().over(W.partitionBy("keyspace").orderBy("table_name"))).join(sizes, "keyspace")
    groups = groups.select("keyspace", "table_name", (F.col("before") + F.col("nth")).cast("int").alias("group_no"))
    lcs = lcs_parse(F.col("lcs"))
    rows = tables.withColumn("v", lcs).filter("v is not null").join(groups, ["keyspace", "table_name"])
    return rows.select("keyspace", "table_name", "node_id", "lcs", (F.col("v.splits") > 0).alias("is_split"), F.col("v.max_level"), F.col("v.first_split"), "group_no")


def tombstone_running(events: DataFrame, keys: Sequence[str] = ("node_id", "keyspace", "table_name")) -> DataFrame:
    """Per node and table: sums of tombstones and live cells read, and of their ratios the number, mean and extremes."""
    ratio = F.try_divide(F.col("tombstones"), F.col("tombstones") + F.col("live_cells"))
    return events.groupBy(*keys).agg(F.sum("tombstones").alias("tombstones"), F.sum("live_cells").alias("live_cells"), F.count(ratio).alias("n"), F.avg(ratio).alias("ratio_avg"), F.max(ratio).alias("ratio_max"), F.min(ratio).alias("ratio_min"))


#: Slices of a value's range, each with about as many distinct values, in which ranks are counted.
VALUE_SLICES = 64


def _value_slice(counts: DataFrame, value: str) -> Column:
    """The number of the slice of a value, by approximate quantiles over all keys; which values they are doesn't matter for ranks."""
    if counts.schema[value].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.lit(0)
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), [k / VALUE_SLICES for k in range(1, VALUE_SLICES)])).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col(value).cast("double"))) if cuts else F.lit(0)


def _value_counts(values: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """The distinct values of each key with their number of rows (c)."""
    return values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))


def bounded_value_sample(values: DataFrame, value: str, keys: Sequence[str], limit: int = 5000, band: int = 100) -> DataFrame:
    """The distinct values of each key, or for keys with `limit` rows or more those among the lowest, middle and highest `band`
    rows, with the number of rows. Ranks come from running counts of distinct values, so a key's rows are combined before
    the shuffle; they are counted in slices of the values' range, behind the rows of the slices before, so a key with any number
    of distinct values is spread over VALUE_SLICES tasks. Null keys are a key."""
    counts = _value_counts(values, value, keys)
    rows = counts.withColumns({"_key": F.struct(*keys), "_slice": _value_slice(counts, value)})
    sums = rows.groupBy("_key", "_slice").agg(F.sum("c").alias("_sum"))
    over = W.partitionBy("_key")
    before = sums.select("_key", "_slice", (F.sum("_sum").over(over.orderBy("_slice")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(over).alias("n"))
    inside = F.sum("c").over(W.partitionBy("_key", "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_to", inside).join(before, ["_key", "_slice"])
    last = F.col("_before") + F.col("_to")
    rows = rows.withColumns({"to": last, "from": last - F.col("c") + 1})
    middle = F.floor((F.col("n") - band) / 2)
    touches = lambda a, b: (F.col("from") <= b) & (F.col("to") >= a)
    keep = (F.col("n") < limit) | touches(F.lit(1), F.lit(band)) | touches(middle + 1, middle + band) | touches(F.col("n") - band + 1, F.col("n"))
    return rows.filter(keep).select(*keys, value, "n")


def value_lists(events: DataFrame, value: str, keys: Sequence[str], limit: int | None = 5000) -> DataFrame:
    """Per key the sorted list of its distinct values and the number of rows: large partition sizes, or the space that compactions
    lacked. From `limit` rows on a key's list is bounded by bounded_value_sample; without a limit every list is whole."""
    rows = _value_counts(events, value, keys) if limit is None else bounded_value_sample(events, value, keys, limit)
    n = F.sum("c") if limit is None else F.first("n")
    return rows.groupBy(*keys).agg(n.alias("n"), F.array_sort(F.collect_list(value)).alias("values"))


def partition_size_list(events: DataFrame, keys: Sequence[str] = ("node_id", "keyspace", "table_name")) -> DataFrame:
    """Large partition sizes (partition_mib) per node and table."""
    return value_lists(events, "partition_mib", keys)


def insufficient_space_list(events: DataFrame, keys: Sequence[str] = ("node_id", "keyspace")) -> DataFrame:
    """Space that compactions lacked (required_mib) per node and keyspace."""
    return value_lists(events, "required_mib", keys)


def tombstone_ratio_list(events: DataFrame, keys: Sequence[str] = ("node_id", "keyspace", "table_name")) -> DataFrame:
    """The ratios of tombstones to all cells read, per node and table: the list behind tombstone_running."""
    return value_lists(events.withColumn("ratio", F.try_divide(F.col("tombstones"), F.col("tombstones") + F.col("live_cells"))), "ratio", keys)


def dropped_messages(documents: DataFrame) -> DataFrame:
    """Insight documents (node_id, ts, data.groups array<struct<name,internal,cross,mean_ms>>) as a row per message group."""
    return documents.select("node_id", "ts", F.explode("data.groups").alias("g")).select("node_id", "ts", F.col("g.name").alias("message"), F.col("g.internal").alias("internal"), F.col("g.cross").alias("cross_node"), F.col("g.mean_ms").alias("mean_ms"))


def compaction_docs(documents: DataFrame) -> DataFrame:
    """Start and end documents of compactions (id, node_id, ts, phase) as a row per finished compaction with its milliseconds."""
    rows = documents.groupBy("node_id", "id").agg(F.min(F.when(F.col("phase") == "start", F.col("ts"))).alias("ts_begin"), F.max(F.when(F.col("phase") == "end", F.col("ts"))).alias("ts_end"))
    return rows.filter("ts_begin is not null and ts_end is not null").withColumn("duration_ms", (F.unix_micros("ts_end") - F.unix_micros("ts_begin")) / 1000.0)


def repair_ran(events: DataFrame) -> DataFrame:
    """Nodes with a repair session end whose status starts with 'success'."""
    return events.groupBy("node_id").agg(F.coalesce(F.bool_or(_class("Repair") & F.col("status").startswith("success")), F.lit(False)).alias("repair_ran"))


#: The columns of each flat fact table.
FACTS = {
    "token_ranges": ("dc", "node_id", "start", "end", "slots", "load_mib"),
    "machines": ("dc", "node_id", "os", "cores", "memory_mib", "heap_mib", "timezone"),
    "log_files": ("dc", "node_id", "path", "is_debug", "used_min", "used_max", "size_mib", "items"),
    "schema_objects": ("keyspace", "name", "kind", "base_table", "compaction"),
    "table_stats": ("source", "dc", "node_id", "keyspace", "table_name", "attr", "num_value", "str_value", "uom"),
}


def fact_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Flat projections of facts in fixed column order; a column that a table lacks is null."""
    pick = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    return {name: df.select(*[pick(df, c) for c in FACTS[name]]) for name, df in tables.items()}


def multi_instance_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with the multi-instance flag and a server id."""
    return nodes.filter("multi_instance and server_id is not null")


def top_documents(documents: DataFrame, n: int, ts: str = "ts", newest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The n newest (or oldest) documents: a top-n report."""
    return documents.orderBy(F.desc(ts) if newest else F.asc(ts), *ties).limit(n)
