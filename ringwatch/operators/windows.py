"""Operators over ordered events: runs, gaps, deltas, timelines, rings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import has_flag
from ..schema import NODE_STATES


def _millis(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n / 1000.0).cast("decimal(18,6)"))


#: Length of a slice of time. A key's slices are worked on apart, so a busy node is spread over tasks.
SLICE_MS = 3_600_000


def time_slice(ts: str, slice_ms: float = SLICE_MS) -> Column:
    """The number of the slice of a time; null times come before all others, as in an ascending order."""
    return F.coalesce(F.floor(F.unix_micros(ts) / F.lit(int(slice_ms * 1000))).cast("long"), F.lit(-(1 << 62)))


def _sliced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], slice_ms: float) -> DataFrame:
    """rows with their key and slice; an order that doesn't begin with a time has one slice."""
    timed = rows.schema[order[0]].dataType.typeName().startswith("timestamp")
    return rows.withColumns({"_key": F.struct(*keys), "_slice": time_slice(order[0], slice_ms) if timed else F.lit(0).cast("long")})


def sliced_lag(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str, slice_ms: float = SLICE_MS) -> DataFrame:
    """rows with a struct of the columns of the row before, by key in the given order, whose first column is a time.

    Within a slice of time this is a window; the first row of a slice takes the last row of the slices before it, of which there
    is one row per key and slice. Null keys are a key."""
    rows = _sliced(rows, keys, order, slice_ms)
    lasts = rows.groupBy("_key", "_slice").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    carried = lasts.select("_key", "_slice", F.lag("_last").over(W.partitionBy("_key").orderBy("_slice")).alias("_last"))
    inside = F.lag(F.struct(*columns)).over(W.partitionBy("_key", "_slice").orderBy(*order))
    return rows.withColumn(name, inside).join(carried, ["_key", "_slice"]).withColumn(name, F.coalesce(name, "_last")).drop("_last", "_key", "_slice")


def sliced_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, slice_ms: float = SLICE_MS) -> DataFrame:
    """rows with the running sum of a value, by key in the given order (first column a time): inside each slice of time, behind the
    sum of the slices before it."""
    rows = _sliced(rows, keys, order, slice_ms).withColumn("_value", value.cast("long"))
    sums = rows.groupBy("_key", "_slice").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_key", "_slice", (F.sum("_sum").over(W.partitionBy("_key").orderBy("_slice")) - F.col("_sum")).alias("_ahead"))
    inside = F.sum("_value").over(W.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, inside).join(before, ["_key", "_slice"]).withColumn(name, F.col(name) + F.col("_ahead")).drop("_ahead", "_value", "_key", "_slice")


def _run_stats() -> list[Column]:
    d = F.col("duration_ms")
    end = F.max_by("ts_end", F.struct("ts_begin", "ts_end"))
    return [F.count(F.lit(1)).alias("occurrences"), F.sum(d).alias("duration_sum"), F.max(d).alias("duration_max"), F.min(d).alias("duration_min"), F.avg(d).alias("duration_mean"), F.stddev_pop(d).alias("duration_std"), F.min("ts_begin").alias("run_begin"), end.alias("run_end")]


def gc_back_to_back(events: DataFrame, keys: Sequence[str] = ("node_id",), tolerance_ms: float = 150) -> DataFrame:
    """Runs of more than one event in which each begins after the previous began and at most `tolerance_ms` after it
    ended: a row per run. events (keys, ts_begin, ts_end, duration_ms); ties on ts_begin are ordered by ts_end, then duration, and
    start a new run. A node's slices of time are worked on apart."""
    order = ("ts_begin", "ts_end", "duration_ms")
    rows = sliced_lag(events.select(*keys, *order), keys, order, order, "_before")
    joins = (F.col("ts_begin") > F.col("_before.ts_begin")) & (F.col("ts_begin") <= F.col("_before.ts_end") + _millis(tolerance_ms))
    rows = sliced_sum(rows.withColumn("_new", F.when(joins, 0).otherwise(1)), keys, (*order, "_new"), F.col("_new"), "_run")
    return rows.groupBy(*keys, "_run").agg(*_run_stats()).filter("occurrences > 1").drop("_run")


#: Slices of the anchored frame are longer: what a slice hands on has a row per event of its last frame at most.
FRAME_SLICE_MS = 6 * 3_600_000


def gc_time_frame(events: DataFrame, keys: Sequence[str] = ("node_id",), frame_ms: float = 300_000, least_ms: float = 75_000, slice_ms: float = FRAME_SLICE_MS) -> DataFrame:
    """Windows anchored at their first event: an event belongs if it begins after the first began and at most `frame_ms`
    after the first ended. Windows with more than one event and `least_ms` of total duration are kept, with the number, sum,
    largest, smallest, mean and deviation of their durations. Ties on ts_begin are ordered by ts_end, then duration; a window with
    an unknown duration has no total and isn't kept; an event without a begin is in no window.

    Which event anchors a window depends on all before it, but a slice of time needs to know of the earlier ones only how far the
    last anchor's frame reaches. First each slice gives this as a step function of what it is told: from every event it
    could start with, pointers to the next anchor are doubled up to the last anchor in the slice. Then the steps of a node are
    followed from slice to slice, a look-up each. Last, each slice starts with what it is told and names every event's anchor,
    and the windows are an aggregate. No task sees all events of a node."""
    frame = round(frame_ms * 1000)
    rows = events.filter(F.col("ts_begin").isNotNull()).select(F.struct(*keys).alias("key"), time_slice("ts_begin", slice_ms).alias("slice"), F.unix_micros("ts_begin").alias("b"), F.unix_micros("ts_end").alias("e"), F.col("duration_ms").cast("double").alias("d"))
    kind = rows.schema["key"].dataType.simpleString()
    dealt = lambda df, *more: df.repartition("key", "slice").sortWithinPartitions("key", "slice", "b", "e", "d", *more)
    steps = dealt(rows).mapInArrow(_frame_steps(frame), f"key {kind}, slice long, upto long, reach long, anchor long")
    told = steps.repartition("key").sortWithinPartitions("key", "slice", "upto").mapInArrow(_frame_states, f"key {kind}, slice long, reach long, anchor long")
    # what a slice is told comes as its first row, not by a join: behind one, Spark takes the rows as dealt already, and an adaptive
    # broadcast then reads them by the task that wrote them, which cuts slices apart
    first = told.select("key", "slice", *[F.lit(None).cast(t).alias(c) for c, t in (("b", "long"), ("e", "long"), ("d", "double"))], "reach", "anchor")
    blank = F.lit(None).cast("long")
    named = dealt(rows.select("*", blank.alias("reach"), blank.alias("anchor")).unionByName(first)).mapInArrow(_frame_anchors(frame), f"key {kind}, anchor long, b long, e long, d double")
    d = F.col("d")
    out = named.groupBy("key", "anchor").agg(
        F.max_by("e", F.struct("b", "e", "d")).alias("end"), F.count(F.lit(1)).alias("occurrences"), F.sum(d).alias("duration_sum"), F.max(d).alias("duration_max"), F.min(d).alias("duration_min"), F.avg(d).alias("duration_mean"), F.stddev_pop(d).alias("duration_std"), F.count(d).alias("_known"),
    ).filter((F.col("occurrences") > 1) & (F.col("_known") == F.col("occurrences")) & (F.col("duration_sum") >= float(least_ms)))
    return out.select(*[F.col("key")[k].alias(k) for k in keys], F.timestamp_micros("anchor").alias("run_begin"), F.timestamp_micros("end").alias("run_end"), "occurrences", "duration_sum", "duration_max", "duration_min", "duration_mean", "duration_std")


def _groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each group, that is of equal values of the named columns, as one batch; the groups come one after the other."""
    held: list[pa.RecordBatch] = []

    def cuts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(0, b.num_rows - 1), bool)
        for name in names:
            column = b.column(name)
            for part in column.flatten() if pa.types.is_struct(column.type) else [column]:
                code = pc.dictionary_encode(part, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new |= code[1:] != code[:-1]
        return np.flatnonzero(new) + 1

    for b in batches:
        if held and b.num_rows:  # whether the held group goes on is seen where its last row meets the first one
            joined = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]).combine_chunks().to_batches()[0]
            if len(cuts(joined)):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        edges = [0, *cuts(b).tolist(), b.num_rows]
        for at, upto in zip(edges, edges[1:]):
            if upto == at:
                continue
            held.append(b.slice(at, upto - at))
            if upto < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_NEVER = np.iinfo(np.int64).min


def _next_anchor(begin: np.ndarray, end: pa.Array, frame: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the frame of each event of a slice would reach, and the position of the anchor after it (the number of events where
    that lies beyond the slice)."""
    known = end.is_valid().to_numpy(zero_copy_only=False)
    reach = np.where(known, pc.fill_null(end, 0).to_numpy(zero_copy_only=False) + frame, _NEVER)
    at = np.arange(len(begin))
    following = np.maximum(at + 1, np.searchsorted(begin, reach, "right"))
    tie = np.r_[begin[1:] == begin[:-1], False]
    return reach, np.where(tie, at + 1, following)


def _frame_steps(frame: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("key", "slice")):
            begin = g.column("b").to_numpy()
            reach, following = _next_anchor(begin, g.column("e"), frame)
            last = np.where(following < len(begin), following, np.arange(len(begin)))
            while not (last[last] == last).all():
                last = last[last]
            runs = np.flatnonzero(np.r_[last[1:] != last[:-1], True])  # the last event of each run of starts with one end
            yield pa.RecordBatch.from_arrays([g.column("key").take(pa.array(runs * 0)), g.column("slice").take(pa.array(runs * 0)), pa.array(begin[runs]), pa.array(reach[last[runs]]), pa.array(begin[last[runs]])], ["key", "slice", "upto", "reach", "anchor"])

    return run


def _frame_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each slice of a key is told: how far the last anchor before it reaches, and that anchor's begin."""
    own, reach, anchor = None, _NEVER, None
    for g in _groups(batches, ("key", "slice")):
        key = g.column("key")[0].as_py()
        if key != own:
            own, reach, anchor = key, _NEVER, None
        yield pa.RecordBatch.from_arrays([g.column("key").slice(0, 1), g.column("slice").slice(0, 1), pa.array([reach]), pa.array([anchor], pa.int64())], ["key", "slice", "reach", "anchor"])
        k = int(np.searchsorted(g.column("upto").to_numpy(), reach, "right"))
        if k < g.num_rows:
            reach, anchor = g.column("reach")[k].as_py(), g.column("anchor")[k].as_py()


def _frame_anchors(frame: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("key", "slice")):
            told, g = g.slice(0, 1), g.slice(1)
            begin = g.column("b").to_numpy()
            _, following = _next_anchor(begin, g.column("e"), frame)
            k = int(np.searchsorted(begin, told.column("reach")[0].as_py(), "right"))
            anchor, kept = np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
            if k:
                anchor[:k] = told.column("anchor")[0].as_py()
            while k < len(begin):
                upto = int(following[k])
                anchor[k:upto] = begin[k]
                kept[k] = not (k + 1 < len(begin) and begin[k + 1] == begin[k])  # followed by a tie it is a window of its own
                k = upto
            some = pa.array(np.flatnonzero(kept))
            yield pa.RecordBatch.from_arrays([g.column("key").take(some), pa.array(anchor[kept]), *(g.column(c).take(some) for c in "bed")], ["key", "anchor", "b", "e", "d"])

    return run


def _by_range(files: DataFrame, keys: Sequence[str]) -> W:
    """Files of a key in the order of their ranges, equal ranges by path where there is one."""
    return W.partitionBy(*keys).orderBy("used_min", "used_max", *[c for c in ("path",) if c in files.columns])


def log_file_gaps(files: DataFrame, keys: Sequence[str] = ("node_id", "is_debug"), gap_minutes: float = 15) -> DataFrame:
    """Each log file against the one before it: kind Duplicated, OverLapping, Normal or Gap, and the gap in minutes.

    files (keys, used_min, used_max), in the order of their ranges. A file is Duplicated if its range equals the one before
    or starts inside it, OverLapping if it starts on an edge of it (our reading of the edges), and else Normal or Gap by
    the time since the one before ended. The first file of a key is Normal with a gap of 0.
    """
    order = _by_range(files, keys)
    start, end = F.lag("used_min").over(order), F.lag("used_max").over(order)
    gap = (F.unix_micros("used_min") - F.unix_micros(end)) / 60e6
    same = (F.col("used_min") == start) & (F.col("used_max") == end)
    inside = (F.col("used_min") > start) & (F.col("used_min") < end)
    kind = F.when(start.isNull(), "Normal").when(same | inside, "Duplicated").when(F.col("used_min") <= end, "OverLapping").when(gap <= gap_minutes, "Normal").otherwise("Gap")
    return files.withColumns({"kind": kind, "gap_minutes": F.when(start.isNull(), 0.0).when(kind.isin("Normal", "Gap"), gap)})


def log_continuous_runs(files: DataFrame, keys: Sequence[str] = ("node_id", "is_debug"), gap_minutes: float = 15, days: float = 4) -> DataFrame:
    """Runs of files without a gap that last `days` or longer: files, items, size, days and range of each, and its kind.

    files (keys, used_min, used_max, items, size). A run's length is the sum of its files' lengths; duplicated and overlapping files
    neither extend nor break it. A run that a gap ends is ContinuousThresholdMet. The last run of a key is so only if two
    files or more, duplicated and overlapping ones included, follow its first one, else DurationThresholdMet."""
    rows = log_file_gaps(files, keys, gap_minutes)
    order = _by_range(files, keys)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("kind") == "Gap", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    part = F.col("kind").isin("Normal", "Gap")
    length = (F.unix_micros("used_max") - F.unix_micros("used_min")) / 86_400e6
    mine = lambda c: F.when(part, c)
    runs = rows.groupBy(*keys, "_run").agg(
        F.count_if(part).alias("files"), F.sum(mine(F.col("items"))).alias("items"), F.sum(mine(F.col("size"))).alias("size"), F.sum(mine(length)).alias("days"),
        F.min(mine(F.col("used_min"))).alias("run_begin"), F.max(mine(F.col("used_max"))).alias("run_end"), (F.count(F.lit(1)) - 1).alias("_more"),
    )
    last = F.col("_run") == F.max("_run").over(W.partitionBy(*keys))
    kind = F.when(last & (F.col("_more") <= 1), "DurationThresholdMet").otherwise("ContinuousThresholdMet")
    return runs.withColumn("kind", kind).filter(F.col("days") >= days).drop("_run", "_more")


def delta_running_total(counters: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A cumulative counter as differences: a smaller value means a restart and counts as it is; the first has none. The first column
    of the order is a time, by whose slices a busy key is spread."""
    own = [c for c in counters.columns if c != "delta"]
    rows = sliced_lag(counters.select(*own), keys, order, [value], "_before")
    before = F.col("_before")[value]
    return rows.select(*own, F.when(before.isNull(), F.lit(None)).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value)).alias("delta"))


def split_at_restarts(files: DataFrame) -> DataFrame:
    """A file with restarts r1..rn as n+1 parts [start, r1.min], [r1.max, r2.min], ..., [rn.max, end]; only the last part
    keeps items. files (..., used_min, used_max, items, restarts array<struct<min,max>>)."""
    r = F.array_sort(F.coalesce("restarts", F.array().cast("array<struct<min:timestamp,max:timestamp>>")))
    starts = F.concat(F.array("used_min"), F.transform(r, lambda x: x["max"]))
    ends = F.concat(F.transform(r, lambda x: x["min"]), F.array("used_max"))
    keep = [c for c in files.columns if c not in ("used_min", "used_max", "items", "restarts")]
    rows = files.select(*keep, "items", F.size(r).alias("last"), F.posexplode(F.arrays_zip(starts.alias("used_min"), ends.alias("used_max"))).alias("part", "range"))
    return rows.select(*keep, "part", "range.used_min", "range.used_max", F.when(F.col("part") == F.col("last"), F.col("items")).otherwise(0).alias("items"))


def node_state_timeline(states: DataFrame, pause_hours: float = 4) -> DataFrame:
    """States without repeats, numbered per node by time and state; pauses above the limit get the long-pause bit.
    states (node_id, ts, state, detected_by, duration_ms); a column nth of theirs is replaced."""
    rows = states.drop("nth").dropDuplicates(["node_id", "ts", "state", "detected_by"])
    long = has_flag(F.col("state"), NODE_STATES["Paused"]) & (F.col("duration_ms") > pause_hours * 3.6e6)
    rows = rows.withColumn("state", F.when(long, F.col("state").bitwiseOR(F.lit(NODE_STATES["LongPause"]))).otherwise(F.col("state")))
    return sliced_sum(rows, ["node_id"], ["ts", "state", "detected_by"], F.lit(1), "nth").withColumn("nth", F.col("nth").cast("int"))


def latest_document(documents: DataFrame, as_of: str, keys: Sequence[str], ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """The newest document of each key up to a time. One pass with partial aggregation: no sort of a key's documents."""
    rest = [c for c in documents.columns if c not in keys and c != ts]
    rows = documents.filter(F.col(ts) <= F.to_timestamp(F.lit(as_of)))
    newest = F.max(F.struct(ts, *ties, *[c for c in rest if c not in ties])).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")


#: Rows of the busiest key in a slice of time on average, the copies a row may have in later slices on average, and how many comparisons
#: a block of events makes at once.
CHAIN_ROWS, CHAIN_COPIES, CHAIN_BLOCK = 1000, 4, 1 << 22


def touched_slices(rows: DataFrame, key: str, begin: str, end: str, per_slice: int = CHAIN_ROWS) -> DataFrame:
    """rows (key, begin and end in microseconds) with `_first` and `_last`, the slices of time in which they begin and end; no slice
    lies beyond the last begin or end that is known. The slices are so long that the busiest key has `per_slice` rows in one on
    average, and that rows touch at most CHAIN_COPIES slices more than one on average: copies grow as the rows do."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(begin).alias("b"), F.max(begin).alias("z"))
    n = n.agg(F.max("n").alias("_most"), F.sum("n").alias("_n"), F.min("b").alias("_low"), F.max("z").alias("_high")).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1))
    length = F.greatest(F.lit(0), F.least(end, "_high") - F.col(begin)).cast("double")
    sums = rows.join(F.broadcast(n), "_one").agg(F.sum(length).alias("_sum"), F.first("_most").alias("_most"), F.first("_n").alias("_n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    wide = F.greatest(F.lit(1.0), (F.col("_high") - F.col("_low")) * float(per_slice) / F.col("_most"), F.col("_sum") / (F.col("_n") * CHAIN_COPIES))
    sums = sums.select(F.ceil(wide).cast("long").alias("_long"), "_low", "_high").withColumn("_one", F.lit(1))
    at = lambda c: F.expr(f"({c} - _low) div _long")
    out = rows.join(F.broadcast(sums), "_one").withColumns({"_first": at(begin), "_last": at(f"greatest({begin}, least({end}, _high))")})
    return out.drop("_one", "_long", "_low", "_high")


def session_parent_chain(events: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """Events with the array of sessions that were open when they began, outermost first.

    events (keys, event_id, session_id, ts_begin, ts_end). A parent comes before in the order of begin, latest end and
    event_id, and ended no earlier, however many sessions lie between; a session that ends before it begins is no
    parent. A key's slices of time are worked on apart. A session is copied to the later slices that it touches, a few on
    average; inside a slice an event is compared with the sessions that are still open, and its parents are put together
    there: pairs are neither shuffled nor sorted, so what is written to disk grows as the events do, not as the pairs."""
    timed = events.filter("ts_begin is not null and ts_end is not null")
    rows = timed.select(F.struct(*keys).alias("key"), F.unix_micros("ts_begin").alias("b"), F.unix_micros("ts_end").alias("e"), F.col("event_id").alias("i"), F.col("session_id").alias("s"), F.struct(*events.columns).alias("row"))
    rows = touched_slices(rows, "key", "b", "e")
    copies = rows.filter("_last > _first").select("key", F.explode(F.sequence(F.col("_first") + 1, "_last")).alias("slice"), "b", "e", "i", "s", F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    dealt = rows.select("key", F.col("_first").alias("slice"), "b", "e", "i", "s", "row").unionByName(copies).repartition("key", "slice")
    dealt = dealt.sortWithinPartitions("key", "slice", "b", F.desc("e"), "i", "s")
    kind = events.schema["session_id"].dataType.simpleString()
    found = dealt.mapInArrow(_open_sessions, f"row {rows.schema['row'].dataType.simpleString()}, parents array<{kind}>")
    untimed = events.filter("ts_begin is null or ts_end is null").select("*", F.array().cast(f"array<{kind}>").alias("parents"))
    return found.select(*[F.col("row")[c].alias(c) for c in events.columns], "parents").unionByName(untimed)


def _open_sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of each slice with their parents: rows in the order of parents, events of earlier slices without a row of their own."""
    for g in _groups(batches, ("key", "slice")):
        begin, end = g.column("b").to_numpy(), g.column("e").to_numpy()
        mine = g.column("row").is_valid().to_numpy(zero_copy_only=False)
        code = pc.dictionary_encode(g.column("i"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        at = np.arange(g.num_rows)
        new = np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]) | (code[1:] != code[:-1])]
        before = np.maximum.accumulate(np.where(new, at, 0))  # rows before this one come before in the order; equal ones don't
        own, session = np.flatnonzero(mine), end >= begin
        far = np.maximum(begin, end)
        seen, open_, k = 0, np.zeros(0, np.int64), 0
        while k < len(own):
            # sessions that ended before the next event begins are no parents of it or of any later one
            first = own[k]
            fresh = np.arange(seen, first)
            open_ = np.r_[open_, fresh[session[fresh]]]
            open_, seen = open_[end[open_] >= begin[first]], first
            upto = min(len(own), k + max(1, CHAIN_BLOCK // (len(open_) + 2048)), k + 2048)
            events = own[k:upto]
            inside = np.arange(first, events[-1] + 1)
            able = np.r_[open_, inside[session[inside]]]
            holds = (end[able][None, :] >= far[events][:, None]) & (able[None, :] < before[events][:, None])
            row, column = np.nonzero(holds)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(events)))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), g.column("s").take(pa.array(able[column])))
            yield pa.RecordBatch.from_arrays([g.column("row").take(pa.array(events)), lists], ["row", "parents"])
            k = upto


#: Fixed value: exceptions about the network.
NETWORK = r"(NativeIoException)|((Closed)?ChannelException)|(TimeoutException)"


def network_state_changes(events: DataFrame, pattern: str = NETWORK) -> DataFrame:
    """A NetworkEvent state for each node that an exception about the network names, or for its own node."""
    rows = events.filter(F.col("exception").rlike(pattern)).select("ts", F.col("node_id").alias("detected_by"), F.explode_outer("assoc_nodes").alias("other"))
    return rows.select(F.coalesce("other", "detected_by").alias("node_id"), "ts", F.lit(NODE_STATES["NetworkEvent"]).cast("long").alias("state"), F.when(F.col("other").isNotNull(), F.col("detected_by")).alias("detected_by"))


def state_counts(states: DataFrame, keys: Sequence[str] = ("dc",)) -> DataFrame:
    """Starts without restarts, restarts, pauses, not responding, dead, network events, and distinct other states."""
    s = F.col("state")
    flag = lambda *names: has_flag(s, sum(NODE_STATES[n] for n in names), all_bits=False)
    known = flag("Started", "Restarted", "Paused", "NotResponding", "Dead", "NetworkEvent")
    return states.groupBy(*keys).agg(
        F.count_if(flag("Started") & ~flag("Restarted")).alias("starts"), F.count_if(flag("Restarted")).alias("restarts"), F.count_if(flag("Paused")).alias("pauses"),
        F.count_if(flag("NotResponding")).alias("not_responding"), F.count_if(flag("Dead")).alias("dead"), F.count_if(flag("NetworkEvent")).alias("network"), F.count_distinct(F.when(~known, s)).alias("others"),
    )


def ring_to_ranges(ring: DataFrame) -> DataFrame:
    """Ring tokens (dc, node_id, token) as ranges (start, end]; the first of a ring wraps from its last token. The window is one task a
    ring; its ranges are spread over tasks again."""
    order = W.partitionBy("dc").orderBy("token")
    last = F.max("token").over(W.partitionBy("dc"))
    return ring.select("dc", "node_id", F.coalesce(F.lag("token").over(order), last).alias("start"), F.col("token").alias("end")).repartition("end")
