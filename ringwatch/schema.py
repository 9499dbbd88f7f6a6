"""Flags and table schemas shared by the operators."""

from __future__ import annotations

#: Event kinds, one bit each.
EVENT_TYPES = {name: 1 << k for k, name in enumerate(("SingleInstance", "SessionBegin", "SessionItem", "SessionEnd", "SessionIgnore", "TimeSpan", "AggregateData", "Exception"))}

#: Event classes, one bit each in this order.
_CLASSES = """Information Warning Error Debug Fatal Orphaned GC Compaction MemtableFlush Hint Repair AntiCompaction Gossip Schema
Exception Pools Cache Memtable Partition Tombstone Batch Drops Timeout Network Shard Solr NodeUp NodeDown NodeStart Shutdown Config
Streaming Storage Authentication DataDirectory CommitLog NodeSync NotHandled Detection Stats""".split()
EVENT_CLASSES = {name: 1 << k for k, name in enumerate(_CLASSES)}
#: Bits that give a line's level or state, not what it is about.
LEVEL_MASK = sum(EVENT_CLASSES[n] for n in ("Information", "Warning", "Error", "Debug", "Fatal"))
ORPHANED = EVENT_CLASSES["Orphaned"]

#: Node states, one bit each.
NODE_STATES = {name: 1 << k for k, name in enumerate(("Added", "Started", "Restarted", "Paused", "LongPause", "NotResponding", "Dead", "NetworkEvent", "TokenOwnershipChanged", "Removed"))}

#: Kinds of work that a workload's name gives a node, fixed values.
INSTANCE_KINDS = ("Cassandra", "Analytics", "Search", "Graph")

LOG_LINE = "path string, node_id string, line_no long, line string"
EVENT = (
    "event_id string, node_id string, dc string, ts timestamp, ts_begin timestamp, ts_end timestamp, duration_ms double, type long, class long, subclass string, "
    "keyspace string, table_name string, analytics_group string, session_key string, exception string, exception_path array<string>, assoc_nodes array<string>, "
    "ddl_items array<string>, sstables array<string>, token_ranges array<struct<start:string,end:string>>, props map<string,string>"
)
STAT = "source string, class string, dc string, node_id string, keyspace string, table_name string, attr string, num_value double, str_value string, uom string"
