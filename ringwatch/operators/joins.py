"""Joins: names, nodes, sessions, configuration, ranges. Small reference tables are left to Catalyst to broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import config_property, config_value_normalize
from ..functions.wide import WIDE_MAX, wide_order
from ..schema import EVENT_TYPES, ORPHANED
from .windows import _groups, touched_slices


def resolve_names(events: DataFrame, names: DataFrame, raw: str = "raw_name", objects: DataFrame | None = None) -> DataFrame:
    """Attach keyspace and table to a raw name: 'table', 'keyspace.table' or an id. names (keyspace, table_name, id).

    With objects (keyspace, name, kind, base_table) the names of indexes and views, also as 'keyspace.name', 'table.name' and
    'keyspace.table.name', give their base table, and the columns object_found and kind_found. Tables come before objects. A
    name without its keyspace resolves only if one keyspace has it. Unknown names get nulls."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"[\"']", ""))
    found = ["keyspace_found", "table_found", *(["object_found", "kind_found"] if objects is not None else [])]
    all_ = [F.col("keyspace").alias("keyspace_found"), F.col("table_name").alias("table_found"), F.lit(None).cast("string").alias("object_found"), F.lit(None).cast("string").alias("kind_found")]
    tables = names.select(*all_, "id")
    whole = lambda rows, rank, *parts: rows.select(F.lit(rank).alias("_rank"), F.lower(F.concat_ws(".", *parts)).alias("_name"), *found)
    alone = lambda rows, rank, *parts: _unique(rows.select(F.lit(rank).alias("_rank"), F.lower(F.concat_ws(".", *parts)).alias("_name"), *found), found)
    known = [whole(tables, 0, "keyspace_found", "table_found"), whole(tables.filter("id is not null"), 1, "id"), alone(tables, 2, "table_found")]
    if objects is not None:
        own = objects.filter("base_table is not null").select(F.col("keyspace").alias("keyspace_found"), F.col("base_table").alias("table_found"), F.col("name").alias("object_found"), F.col("kind").alias("kind_found"))
        known += [whole(own, 3, "keyspace_found", "object_found"), whole(own, 4, "keyspace_found", "table_found", "object_found"), alone(own, 5, "table_found", "object_found"), alone(own, 6, "object_found")]
    each = reduce(DataFrame.unionByName, known).groupBy("_name").agg(F.min(F.struct("_rank", *found)).alias("_best")).select("_name", *[F.col(f"_best.{c}").alias(c) for c in found])
    return events.drop(*found).join(each, clean(F.col(raw)) == F.col("_name"), "left").drop("_name")


def _unique(rows: DataFrame, found: Sequence[str]) -> DataFrame:
    """The names that one keyspace only has."""
    one = rows.groupBy("_rank", "_name").agg(F.min(F.struct(*found)).alias("_one"), F.count_distinct("keyspace_found").alias("_n")).filter("_n = 1")
    return one.select("_rank", "_name", *[F.col(f"_one.{c}").alias(c) for c in found])


def resolve_nodes(events: DataFrame, hosts: DataFrame, raw: str = "address") -> DataFrame:
    """Attach node and data center by address or host name. hosts (name, node_id, dc), one row per name."""
    known = hosts.select(F.lower("name").alias("_host"), F.col("node_id").alias("node_found"), F.col("dc").alias("dc_found")).dropDuplicates(["_host"])
    return events.drop("node_found", "dc_found").join(known, F.lower(raw) == F.col("_host"), "left").drop("_host")


def unknown_nodes(events: DataFrame, hosts: DataFrame, raw: str = "address") -> DataFrame:
    """The raw addresses that no host row names."""
    return events.select(raw).filter(F.col(raw).isNotNull()).distinct().join(hosts.select(F.lower("name").alias("host_name")), F.lower(raw) == F.col("host_name"), "left_anti")


def pair_sessions(events: DataFrame, keys: Sequence[str] = ("node_id", "session_key"), order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Session ends with their begin. events (keys, event_id, ts, type) -> begins, items and ends with session_id, ts_begin,
    duration_ms and orphaned.

    The open begin is the last one since the last end. An end takes its id and time; an end without one, and a begin that
    another begin or nothing follows instead of an end, are orphaned. A window per (node, session key): no self-join. The
    events' own columns of these four names are replaced.

    A row with the bits of begin and item is an item of an open session, else a begin. An item that may also be single
    (SingleInstance) is single, not orphaned, without an open session; one to ignore (SessionIgnore) is left out then. Their
    `type` keeps the bits of what they are.
    """
    over = W.partitionBy(*keys).orderBy(*order)
    bit = _bit
    either, alone, ignore = bit("SessionBegin") & bit("SessionItem"), bit("SessionItem") & bit("SingleInstance"), bit("SessionItem") & bit("SessionIgnore")
    inside = F.coalesce(F.last(F.when(bit("SessionBegin"), True).when(bit("SessionEnd"), False), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    without = lambda *names: F.col("type").bitwiseAND(F.lit(~sum(EVENT_TYPES[n] for n in names)))
    kind = F.when(either & inside, without("SessionBegin", "SingleInstance")).when(either, without("SessionItem", "SingleInstance")).when(alone & inside, without("SingleInstance")).when(alone, without("SessionItem")).otherwise(F.col("type"))
    events = events.withColumn("_inside", inside).filter(~ignore | F.col("_inside") | bit("SessionBegin")).drop("_inside").withColumn("_single", alone & ~either & ~inside).withColumn("type", kind)
    begin, end = bit("SessionBegin"), bit("SessionEnd")
    mark = F.when(begin, F.struct(F.lit(True).alias("open"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("ts"))).when(end, F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("timestamp").alias("ts")))
    rows = events.withColumn("_mark", mark)
    rows = rows.withColumn("_seen", F.last("_mark", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)))
    # the next mark is the last one of the reversed order, whose frame only grows: linear in the rows of a key
    back = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = rows.withColumn("_next", F.last("_mark", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    open_ = F.coalesce(F.col("_seen.open"), F.lit(False))
    session = F.when(begin, F.col("event_id").cast("string")).when(open_, F.col("_seen.id"))
    started = F.when(begin, F.col("ts")).when(open_, F.col("_seen.ts"))
    orphan = F.when(end, ~open_).when(begin, F.coalesce(F.col("_next.open"), F.lit(True))).otherwise(~open_ & ~F.col("_single"))
    took = F.when(end & open_, (F.unix_micros("ts") - F.unix_micros("_seen.ts")) / 1000.0)
    own = [c for c in events.columns if c not in ("session_id", "ts_begin", "duration_ms", "orphaned", "_single")]
    return rows.select(*own, session.alias("session_id"), started.alias("ts_begin"), took.alias("duration_ms"), orphan.alias("orphaned"))


def _bit(name: str) -> Column:
    return F.coalesce(F.col("type").bitwiseAND(F.lit(EVENT_TYPES[name])) != 0, F.lit(False))


def repair_orphans(paired: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """pair_sessions' rows with orphans repaired where they can be, and how: `repair` is same_tick, open_prefix or null.

    Lines of one time are written in either order: an orphaned end or item at the very time of an end of its session key takes
    that end's session, and an end at the very time of an orphaned begin that follows it takes that begin, which is no orphan
    then. Any other orphaned end takes the latest session on its node (keys) that is open at its time, whose session_key starts
    with the end's and whose table agrees: (keyspace, table_name) where the end names both, else the keyspace where it names
    one. A repaired end has its begin's session_id, ts_begin and duration_ms. Columns keyspace and table_name are optional; a
    column repair is replaced."""
    given = [c for c in paired.columns if c != "repair"]
    begin, end, orphan = _bit("SessionBegin"), _bit("SessionEnd"), F.col("orphaned")
    tick = W.partitionBy(*keys, "session_key", "ts").orderBy("event_id")
    session = F.struct("session_id", "ts_begin")
    rows = paired.select(*given).withColumn("_before", F.last(F.when(end & ~orphan, session), ignorenulls=True).over(tick.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_after", F.when(end & orphan & F.col("_before").isNull(), F.lead(F.when(begin & orphan, session)).over(tick)))
    rows = rows.withColumn("_taken", begin & orphan & F.coalesce(F.lag("_after").over(tick).isNotNull(), F.lit(False)))
    rows = rows.withColumn("_found", F.when(orphan & ~begin & F.col("_before").isNotNull(), F.col("_before")).otherwise(F.col("_after")))
    return _open_prefix(_joined(rows, "same_tick", F.col("_taken")).select(*given, "repair"), keys)


def _joined(rows: DataFrame, how: str, taken: Column) -> DataFrame:
    """rows with the session in `_found` taken over, and `repair`."""
    found = F.col("_found").isNotNull()
    took = (F.unix_micros("ts") - F.unix_micros("_found.ts_begin")) / 1000.0
    repair = F.when(found | taken, how).otherwise(F.col("repair") if "repair" in rows.columns else F.lit(None).cast("string"))
    return rows.withColumns({
        "session_id": F.when(found, F.col("_found.session_id")).otherwise(F.col("session_id")), "ts_begin": F.when(found, F.col("_found.ts_begin")).otherwise(F.col("ts_begin")),
        "duration_ms": F.when(found & _bit("SessionEnd"), took).otherwise(F.col("duration_ms")), "orphaned": F.col("orphaned") & ~found & ~taken, "repair": repair,
    })


def _open_prefix(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Orphaned ends joined to the latest open session whose key starts with theirs.

    A session is open from its begin to the next begin or end of its key. One that is closed stands in the one or two cells of
    time, of a power of two not shorter than it, that it touches, and an orphan looks into the cell of its time at each width in
    use: an equi-join whose pairs are the sessions open about then. Of those never closed the latest one before counts: a
    running last value. Both by node, the key's first characters at the lengths that orphans' keys have, and what must agree."""
    names = [f"_k{n}" for n in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    spot, begin, end = F.struct("ts", "event_id"), _bit("SessionBegin"), _bit("SessionEnd")
    keyspace, table = (F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("keyspace", "table_name"))
    named = [F.lit(""), F.concat(F.lit("k"), keyspace), F.concat(F.lit("t"), keyspace, F.lit("\0"), table)]
    back = W.partitionBy(*keys, "session_key").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, -1)
    orphans = rows.filter(end & F.col("orphaned") & F.col("session_key").isNotNull()).select(*own, F.col("session_key").alias("_prefix"), F.coalesce(*reversed(named)).alias("_agree"), spot.alias("_spot")).distinct()
    sizes = orphans.groupBy(*names).agg(F.collect_set(F.length("_prefix")).alias("_sizes"))
    open_ = rows.withColumn("_close", F.last(F.when(begin | end, spot), ignorenulls=True).over(back)).filter(begin & F.col("repair").isNull() & F.col("session_key").isNotNull())
    open_ = open_.select(*own, F.col("session_key").alias("_key"), spot.alias("_from"), "_close", F.struct("session_id", "ts_begin").alias("_session"), F.explode(F.array_compact(F.array(*named))).alias("_agree"))
    open_ = open_.join(sizes, names).withColumn("_size", F.explode("_sizes")).filter(F.col("_size") <= F.length("_key")).withColumn("_prefix", F.substring(F.col("_key"), F.lit(1), F.col("_size"))).drop("_sizes", "_size", "_key")
    by = [*names, "_prefix", "_agree"]
    open_ = open_.join(orphans.select(*by).distinct(), by, "left_semi")
    # never closed: the latest before
    every = open_.filter("_close is null").select(*by, F.col("_from").alias("_spot"), F.struct("_from", "_session").alias("_open")).unionByName(orphans.select(*by, "_spot"), allowMissingColumns=True)
    latest = every.withColumn("_open", F.when(F.col("_open").isNull(), F.last("_open", ignorenulls=True).over(W.partitionBy(*by).orderBy("_spot", F.col("_open").isNotNull()).rowsBetween(W.unboundedPreceding, -1)))).filter("_open is not null")
    # closed: the cells of time
    start, stop = F.unix_micros("_from.ts"), F.unix_micros("_close.ts")
    closed = open_.filter("_close is not null").withColumns({"_width": F.greatest(F.lit(20), F.length(F.bin(stop - start))), "_start": start, "_stop": stop})
    closed = closed.withColumn("_cell", F.explode(F.expr("array_distinct(array(shiftright(_start, _width), shiftright(_stop, _width)))")))
    looks = orphans.join(closed.groupBy(*by).agg(F.collect_set("_width").alias("_widths")), by).withColumn("_width", F.explode("_widths")).withColumn("_cell", F.expr("shiftright(unix_micros(_spot.ts), _width)"))
    pairs = looks.drop("_widths").join(closed, [*by, "_width", "_cell"]).filter((F.col("_from") < F.col("_spot")) & (F.col("_close") > F.col("_spot")))
    both = pairs.select(*by, "_spot", F.struct("_from", "_session").alias("_open")).unionByName(latest)
    best = both.groupBy(*by, "_spot").agg(F.max("_open")["_session"].alias("_found"))
    best = best.select(*names, F.col("_prefix").alias("_key"), F.col("_agree").alias("_same"), F.col("_spot.ts").alias("_ts"), F.col("_spot.event_id").alias("_id"), "_found")
    on = (F.col("session_key") == F.col("_key")) & (F.col("_agree") == F.col("_same")) & (F.col("ts") == F.col("_ts")) & (F.col("event_id") == F.col("_id")) & F.col("_lost")
    for k, n in zip(keys, names, strict=True):
        on &= F.col(k) == F.col(n)
    out = rows.withColumns({"_agree": F.coalesce(*reversed(named)), "_lost": end & F.col("orphaned")}).join(best, on, "left")
    return _joined(out, "open_prefix", F.lit(False)).select(*rows.columns)


def orphan_events(repaired: DataFrame) -> DataFrame:
    """The begins, items and ends that stay orphans after repair_orphans, with the orphan class bit."""
    rows = repaired.filter("orphaned")
    return rows.withColumn("class", F.coalesce("class", F.lit(0)).cast("long").bitwiseOR(F.lit(ORPHANED))) if "class" in repaired.columns else rows


def config_changes(seen: DataFrame, current: DataFrame) -> DataFrame:
    """Configuration seen at start-up (node_id, ts, props map) that differs from the current lines (node_id, property, value)
    or is missing there; compared after normalising."""
    old = seen.select("node_id", "ts", F.explode("props").alias("property", "old_value")).withColumn("p", config_property(F.col("property")))
    new = current.groupBy(F.col("node_id").alias("n"), config_property(F.col("property")).alias("q")).agg(F.min("value").alias("new_value"))
    rows = old.join(new, (old["node_id"] == new["n"]) & (old["p"] == new["q"]), "left").drop("n", "q", "p")
    return rows.filter(~config_value_normalize(F.col("old_value")).eqNullSafe(config_value_normalize(F.col("new_value")))).distinct()


def attach_common_key(tables: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows (keyspace, table_name, dc, ...) with the common-key factor of the same table and data center."""
    return tables.join(factors.select("keyspace", "table_name", "dc", F.col("factor").alias("common_key_factor")), ["keyspace", "table_name", "dc"], "left")


def attach_base_table(rows: DataFrame, objects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Index and view rows with the columns of their base table on the same node, as base_<column>. objects (keyspace,
    table_name, base_table)."""
    base = rows.select(F.col("keyspace").alias("k"), F.col("table_name").alias("b"), F.col("node_id").alias("n"), *[F.col(c).alias(f"base_{c}") for c in columns])
    own = rows.join(objects.select("keyspace", "table_name", "base_table"), ["keyspace", "table_name"], "left")
    return own.join(base, (own["keyspace"] == base["k"]) & (own["base_table"] == base["b"]) & (own["node_id"] == base["n"]), "left").drop("k", "b", "n")


def attach_dependents_count(tables: DataFrame, objects: DataFrame) -> DataFrame:
    """Tables with the numbers of their indexes and views. objects (keyspace, base_table, kind)."""
    counts = objects.groupBy("keyspace", F.col("base_table").alias("table_name")).agg(F.count_if(F.col("kind") == "index").alias("indexes"), F.count_if(F.col("kind") == "view").alias("views"))
    return tables.join(counts, ["keyspace", "table_name"], "left").fillna(0, ["indexes", "views"])


def device_utilization(nodes: DataFrame, mounts: DataFrame) -> DataFrame:
    """Utilisation of each node's data and commit-log device: that of the mount whose key ends in '/device' or '/device1'.

    nodes (node_id, data_devices array, commit_device, ...), mounts (node_id, mount, used_pct). Keys match by their last
    path segment, an equi-join; of several mounts the first by name counts; the first data device counts. The cache
    device has its own column."""
    keys = mounts.select(F.col("node_id").alias("n"), "mount", "used_pct", F.regexp_extract("mount", r"([^/]+)$", 1).alias("last"))
    used = keys.select("n", F.explode(F.array_distinct(F.array("last", F.regexp_replace("last", "1$", "")))).alias("device"), "mount", "used_pct")
    used = used.groupBy("n", "device").agg(F.min_by("used_pct", "mount").alias("used_pct"))
    out = nodes.withColumn("data_device", F.try_element_at("data_devices", F.lit(1)))
    for role in [r for r in ("data", "commit", "cache") if f"{r}_device" in out.columns]:
        own = used.select("n", F.col("device").alias("d"), F.col("used_pct").alias(f"{role}_used_pct"))
        out = out.join(own, (out["node_id"] == own["n"]) & (out[f"{role}_device"] == own["d"]), "left").drop("n", "d")
    return out


def trim_overlaps(files: DataFrame, keys: Sequence[str] = ("node_id", "is_debug"), order: Sequence[str] = ("file_min", "path")) -> DataFrame:
    """Files (keys, path, file_min, file_max) in the order in which they are processed, each with the part of its range that no
    file before it covers, as (status, used_min, used_max).

    within: one file before it covers its range, so it is skipped. error: its start lies in one file before it and its end
    in another, so it spans them and is skipped too. trimmed: only its start, or only its end, lies in a file before it,
    and the rest counts. new: neither does, even if it holds whole files. A start on an edge lies in the file, an end on an
    edge doesn't (our reading). A file stands in each slice of time that it touches, a few on average, and its ends look into
    theirs. In a slice pairs aren't formed: the furthest end before a start, and the first begin before an end, are
    running extremes in halves of halves, so the work is n log² n."""
    ids = [*keys, "file_min", "file_max", *[c for c in order if c not in ("file_min", "file_max", *keys)]]
    one = files.select(*ids).filter("file_min is not null and file_max is not null and file_min <= file_max").distinct()
    rank = [f"r{k}" for k in range(len(order))]
    one = one.select(F.struct(*keys).alias("key"), F.unix_micros("file_min").alias("a"), F.unix_micros("file_max").alias("z"), *[F.col(c).alias(r) for c, r in zip(order, rank, strict=True)], F.struct(*ids).alias("id"))
    one = touched_slices(one, "key", "a", "z")
    none = F.lit(None).cast(one.schema["id"].dataType)
    stands = one.select("key", F.explode(F.sequence("_first", "_last")).alias("slice"), F.lit(0).alias("what"), "a", "z", *rank, none.alias("id"))
    look = lambda what, at: one.select("key", F.col(at).alias("slice"), F.lit(what).alias("what"), "a", "z", *rank, "id")
    dealt = stands.unionByName(look(1, "_first")).unionByName(look(2, "_last")).repartition("key", "slice").sortWithinPartitions("key", "slice", *rank)
    found = dealt.mapInArrow(_covering_ends(rank), f"id {one.schema['id'].dataType.simpleString()}, after long, until long")
    found = found.groupBy("id").agg(F.timestamp_micros(F.max("after")).alias("_after"), F.timestamp_micros(F.min("until")).alias("_until"))
    found = found.select(*[F.col("id")[c].alias(f"_{c}") for c in ids], "_after", "_until")
    columns = [c for c in files.columns if c not in ("status", "used_min", "used_max")]
    rows = files.join(found, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]), "left")
    after, until = F.col("_after"), F.col("_until")
    status = F.when(after >= F.col("file_max"), "within").when(after.isNotNull() & until.isNotNull(), "error").when(after.isNotNull() | until.isNotNull(), "trimmed").otherwise("new")
    used = status.isin("new", "trimmed")
    return rows.select(*columns, status.alias("status"), F.when(used, F.coalesce(after, "file_min")).alias("used_min"), F.when(used, F.coalesce(until, "file_max")).alias("used_max"))


def _largest_before(place: np.ndarray, rank: np.ndarray, value: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """For each row that asks the largest value among the others with a smaller place and a smaller rank, 0 where there is none. Places
    are distinct, values above 0. The places are halved again and again: the left half of each pair of halves gives the
    right one its largest values so far by rank."""
    n = len(place)
    best, by_rank = np.zeros(n, np.int64), np.lexsort((~asks, rank))  # of equal ranks those that ask come first
    place, rank, value, asks = place[by_rank], rank[by_rank], value[by_rank], asks[by_rank]
    top = int(value.max(initial=0)) + 1
    half = 1
    while half < n:
        pair = place // (2 * half)
        to = np.argsort(pair, kind="stable")
        left = (place[to] // half) % 2 == 0
        base = pair[to] * top
        so_far = np.maximum.accumulate(base + np.where(left & ~asks[to], value[to], 0)) - base
        mine = ~left & asks[to]
        best[to[mine]] = np.maximum(best[to[mine]], so_far[mine])
        half *= 2
    out = np.zeros(n, np.int64)
    out[by_rank] = best
    return out


def _covering_ends(rank: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("key", "slice")):
            n, what = g.num_rows, g.column("what").to_numpy()
            new = np.r_[True, np.zeros(n - 1, bool)]
            for name in rank:
                code = pc.dictionary_encode(g.column(name), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            nth, a, z = np.cumsum(new), g.column("a").to_numpy(), g.column("z").to_numpy()

            def extreme(asked: int, at: np.ndarray, first: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Whether each row finds a value, and the largest one that it finds."""
                some = np.flatnonzero((what == 0) | (what == asked))
                asks = what[some] == asked
                place = np.empty(len(some), np.int64)
                place[np.lexsort((np.where(asks, first[1], first[0]), at[some]))] = np.arange(len(some))
                kinds, codes = np.unique(value[some], return_inverse=True)
                best = _largest_before(place, nth[some], codes + 1, asks)
                out, hit = np.zeros(n, np.int64), best > 0
                known = np.zeros(n, bool)
                known[some[hit]], out[some[hit]] = True, kinds[best[hit] - 1]
                return known, out

            # files that begin at a start or before it, and the furthest of their ends; it counts if it lies at the start or behind it
            known, after = extreme(1, a, (0, 1), z)
            after_known = known & (after >= a)
            # files that end behind an end, and the first of their begins; it counts if it lies before the end
            known, until = extreme(2, -z, (1, 0), -a)
            until = -until
            until_known = known & (until < z)
            asking = np.flatnonzero(what > 0)
            yield pa.RecordBatch.from_arrays([g.column("id").take(pa.array(asking)), pa.array(after[asking], mask=~after_known[asking]), pa.array(until[asking], mask=~until_known[asking])], ["id", "after", "until"])

    return run


def _ring_key(rows: DataFrame, column: str) -> Column:
    """A token column as something that sorts as tokens do: whole numbers of 64 bits, and digits as limbs of digits."""
    return wide_order(F.col(column)) if rows.schema[column].dataType.typeName() == "string" else F.col(column).cast("long")


def _coarse(key: Column, wide: bool) -> Column:
    return key["hi"] if wide else key


def _ring_cells(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ring ranges (start, end], those that wrap split at the ring's ends, once per cell that they touch: the one or two cells of the
    smallest power of two of tokens that isn't shorter than the range; and the widths in use, a row. A range that begins at the
    ring's end has no lower bound."""
    wide = ranges.schema["start"].dataType.typeName() == "string"
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    top = wide_order(F.lit(str(WIDE_MAX))) if wide else high
    rows = ranges.withColumns({"_start": _ring_key(ranges, "start"), "_end": _ring_key(ranges, "end")})
    s, e = F.col("_start"), F.col("_end")
    part = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    rows = rows.withColumn("_part", F.explode(F.when(s < e, F.array(part(s, e))).otherwise(F.array(part(s, top), part(F.nullif(s, s), e)))))
    first, last = F.coalesce(_coarse(F.col("_part.s"), wide), low), _coarse(F.col("_part.e"), wide)
    length = last.cast("double") - first.cast("double")
    width = F.least(F.lit(63), F.ceil(F.log2(length + 2)) + 1).cast("int")  # a double may be short by rounding; one bit more covers it
    rows = rows.withColumn("_width", width).withColumns({"_first": first, "_last": last})
    cut = rows.withColumn("_cell", F.explode(F.expr("array_distinct(array(shiftright(_first, _width), shiftright(_last, _width)))"))).drop("_first", "_last")
    return cut, cut.agg(F.collect_set("_width").alias("_widths"))


def _looking(points: DataFrame, key: str, wide: bool, widths: DataFrame) -> DataFrame:
    """points once per width in use, with the cell of the token in `key`."""
    rows = points.withColumn("_one", F.lit(1)).join(F.broadcast(widths.withColumn("_one", F.lit(1))), "_one").withColumn("_width", F.explode("_widths")).drop("_one", "_widths")
    return rows.withColumn("_at", _coarse(F.col(key), wide)).withColumn("_cell", F.expr("shiftright(_at, _width)")).drop("_at")


def tokens_containing(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Tokens (token) with the ring range (dc, node_id, start, end) they lie in: start < token <= end. Tokens and ends are whole
    numbers of 64 bits, or the digits of 128-bit ones in strings.

    A range stands in one or two cells of its own size, and a token looks into its cell of each size in use: an equi-join on size and
    cell and a filter, never a nested loop. A token meets a few ranges of each size, however many there are in the ring."""
    wide = ranges.schema["start"].dataType.typeName() == "string"
    cut, widths = _ring_cells(ranges)
    rows = _looking(tokens.withColumn("_token", _ring_key(tokens, "token")), "_token", wide, widths)
    inside = (F.col("_part.s").isNull() | (F.col("_token") > F.col("_part.s"))) & (F.col("_token") <= F.col("_part.e"))
    return rows.join(cut, ["_width", "_cell"]).filter(inside).drop("_width", "_cell", "_part", "_token", "_start", "_end")


def ranges_containing(checks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Token ranges (check_start, check_end) with each ring range (dc, node_id, start, end) that takes their end (start < end of
    the check <= end) or their start (start < start of the check < end). A range of the ring that lies whole inside a check
    takes neither. Each pair comes once. The two ends look into their cells: an equi-join, as in tokens_containing."""
    wide = ranges.schema["start"].dataType.typeName() == "string"
    cut, widths = _ring_cells(ranges)
    points = checks.withColumn("_x", _ring_key(checks, "check_end"))
    ends = F.array(F.struct(F.lit(True).alias("last"), F.col("_x").alias("at")), F.struct(F.lit(False).alias("last"), _ring_key(checks, "check_start").alias("at")))
    points = _looking(points.withColumn("_point", F.explode(ends)), "_point.at", wide, widths)
    at, last, x, s, e = F.col("_point.at"), F.col("_point.last"), F.col("_x"), F.col("_start"), F.col("_end")
    inside = (F.col("_part.s").isNull() | (at > F.col("_part.s"))) & (at <= F.col("_part.e")) & (last | (at != e))
    whole = F.when(s < e, (x > s) & (x <= e)).otherwise((x > s) | (x <= e))
    return points.join(cut, ["_width", "_cell"]).filter(inside & (last | ~F.coalesce(whole, F.lit(False)))).drop("_width", "_cell", "_part", "_point", "_x", "_start", "_end")


def flagged_tables_semi(rows: DataFrame, flag: Column) -> DataFrame:
    """All rows of the tables that are flagged in any row."""
    return rows.join(rows.filter(flag).select("keyspace", "table_name").distinct(), ["keyspace", "table_name"], "left_semi")


def late_name_resolution(events: DataFrame) -> DataFrame:
    """Events of a session whose table was unknown get the one its end names: the last by time, then event_id.
    events (session_id, ts, keyspace, table_name)."""
    over = W.partitionBy("session_id").orderBy("ts", *[c for c in ("event_id",) if c in events.columns]).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = lambda c: F.when(F.col("session_id").isNotNull(), F.last(c, ignorenulls=True).over(over))
    return events.withColumns({c: F.coalesce(F.col(c), last(c)) for c in ("keyspace", "table_name")})


def keyspace_in_dc(stats: DataFrame, replications: DataFrame) -> DataFrame:
    """A marker row for each (dc, node, keyspace) with stats whose keyspace isn't replicated in that data center."""
    lost = stats.select("dc", "node_id", "keyspace").distinct().join(replications.select("dc", "keyspace").distinct(), ["dc", "keyspace"], "left_anti")
    return lost.withColumns({"attr": F.lit("Parser-Error"), "str_value": F.concat(F.lit("keyspace "), "keyspace", F.lit(" isn't replicated in "), "dc")})
