"""Whole flows: log text to aggregated rows, and statistics to tagged tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import joins as J
from ..operators import stats as S
from ..operators import windows as Wn
from ..schema import EVENT_CLASSES, EVENT_TYPES
from ..sources import text as T

#: Starter rules for the most common lines of a wide-column database's logs. The first match wins.
RULES: list[Mapping] = [
    {"tag": "gc", "message": r"GC in ", "parse": [r"(?P<collector>[\w ]+?) GC in (?P<pause_ms>\d+)ms", r"GC in (?P<pause_ms>\d+)"], "class": EVENT_CLASSES["GC"], "analytics_group": "GCPauseStats"},
    {"tag": "compaction_begin", "message": r"^Compacting ", "parse": [r"Compacting \((?P<id>[0-9a-f-]+)\)", r"Compacting \[(?P<id>\S+)"], "type": EVENT_TYPES["SessionBegin"], "class": EVENT_CLASSES["Compaction"], "session_key": "thread"},
    {"tag": "compaction_end", "message": r"^Compacted ", "parse": [r"Compacted (?:\((?P<id>[0-9a-f-]+)\))? ?(?P<sstables>\d+) sstables"], "type": EVENT_TYPES["SessionEnd"], "class": EVENT_CLASSES["Compaction"], "analytics_group": "CompactionStats", "session_key": "thread"},
    {"tag": "flush_begin", "message": r"^(?:Enqueuing flush|Writing Memtable)", "parse": [r"(?:flush of|Memtable-)(?P<table>\w+)"], "type": EVENT_TYPES["SessionBegin"], "class": EVENT_CLASSES["MemtableFlush"], "session_key": "thread"},
    {"tag": "flush_end", "message": r"^Completed flushing", "parse": [r"Completed flushing (?P<path>\S+)"], "type": EVENT_TYPES["SessionEnd"], "class": EVENT_CLASSES["MemtableFlush"], "analytics_group": "FlushStats", "session_key": "thread"},
    {"tag": "large_partition", "message": r"(?:Writing|Compacting) large (?:partition|row)", "parse": [r"large (?:partition|row) (?P<keyspace>[^/]+)/(?P<table>[^:]+):\S* \((?P<bytes>[\d.]+)"], "class": EVENT_CLASSES["Partition"], "analytics_group": "LargePartitionRowStats"},
    {"tag": "tombstones", "message": r"tombstone cells", "parse": [r"Read (?P<live_cells>\d+) live rows? and (?P<tombstones>\d+) tombstone cells", r"(?P<live_cells>\d+) live and (?P<tombstones>\d+) tombstone"], "class": EVENT_CLASSES["Tombstone"], "analytics_group": "TombstoneStats"},
    {"tag": "gossip", "message": r"Gossip stage has", "parse": [r"has (?P<pending_tasks>\d+) pending"], "class": EVENT_CLASSES["Gossip"], "analytics_group": "GossipPendingStats"},
    {"tag": "batch", "message": r"Batch", "parse": [r"Batch .* of size (?P<batch_kib>[\d.]+)KiB"], "class": EVENT_CLASSES["Batch"], "analytics_group": "BatchStats"},
    {"tag": "drops", "message": r"messages were dropped", "parse": [r"(?P<message>\w+) messages were dropped .*?(?P<dropped_internal>\d+) (?:for )?internal .*?(?P<dropped_cross_node>\d+) (?:for )?cross.node"], "class": EVENT_CLASSES["Drops"], "analytics_group": "DropStats"},
    {"tag": "hints", "message": r"hinted handoff", "parse": [r"(?P<hint_rows>\d+) rows"], "class": EVENT_CLASSES["Hint"], "analytics_group": "HintHandOffStats"},
    {"tag": "node_up", "message": r"is now UP", "parse": [r"/?(?P<node>[0-9.]+) is now UP"], "class": EVENT_CLASSES["NodeUp"]},
    {"tag": "node_down", "message": r"is now DOWN", "parse": [r"/?(?P<node>[0-9.]+) is now DOWN"], "class": EVENT_CLASSES["NodeDown"]},
    {"tag": "start", "message": r"^(?:Starting listening|Node .* state jump to)", "class": EVENT_CLASSES["NodeStart"]},
    {"tag": "shutdown", "message": r"(?i)shutting down|announcing shutdown", "class": EVENT_CLASSES["Shutdown"]},
]


def log_flow(lines: DataFrame, layout: str = T.DEFAULT_LAYOUT, rules: Sequence[Mapping] = RULES, zone: str = "UTC") -> DataFrame:
    """Log lines to classified events: records, headers, UTC times, rules, properties, session key, distinct lines."""
    rows = T.parse_header(T.assemble_records(lines, layout), layout)
    rows = rows.withColumn("ts", F.to_utc_timestamp("ts", zone))
    return E.drop_duplicate_lines(E.classify_events(rows, rules))


def log_to_aggregation(lines: DataFrame, minutes: int = 30, **settings) -> DataFrame:
    """Log lines to counts and pair durations per bucket, node and kind of event (GROUP_KEY): one shuffle by record, one by session,
    one by key."""
    rows = log_flow(lines, **settings).filter("rule is not null").withColumn("event_id", F.concat_ws(":", "path", F.lpad("line_no", 12, "0")))
    single = rows.filter("session_key is null").withColumn("duration_ms", F.lit(None).cast("double"))
    paired = J.repair_orphans(J.pair_sessions(rows.filter("session_key is not null").drop("duration_ms"), ["node_id", "session_key"])).filter(~F.col("orphaned") & F.col("type").bitwiseAND(F.lit(EVENT_TYPES["SessionEnd"])).cast("boolean"))
    every = single.unionByName(paired.select(*single.columns), allowMissingColumns=True)
    return E.log_aggregation(E.with_group_key(every), ["node_id", *E.GROUP_KEY], minutes)


def tagged_flow(stats: DataFrame, attrs: Mapping[str, str], trigger: float = 0.9) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Long statistics to tagged tables per data center, and the roll-up of each weighed attribute."""
    tagged = S.tagged_tables(stats, attrs, ["dc", "keyspace", "table_name"])
    return tagged, {a: S.tagged_rollup(tagged, a, trigger) for a in attrs}


def coverage_flow(files: DataFrame, gap_minutes: float = 15) -> tuple[DataFrame, DataFrame]:
    """Log files to coverage per node and per data center."""
    node = S.log_coverage_node(Wn.log_file_gaps(files, gap_minutes=gap_minutes))
    return node, S.log_coverage_dc(node)
