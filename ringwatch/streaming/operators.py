"""Structured Streaming variants: tumbling aggregation, session pairing, bursts, frames, deltas, duplicates.

The stateful ones (T2 to T5) hold a key's rows back until the watermark has passed them and fold them in the order of
time then, so rows that arrive late, but within the watermark, give the rows of the batch operators. A key's state is the
rows of the time `late`, in lists by slices of time to which a batch appends, and one small value; timers wake it. Rows without a time are left out; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import item_stats
from ..schema import EVENT_TYPES


def stream_log_aggregation(events: DataFrame, keys: Sequence[str], period: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """T1: count, first and last time and duration statistics per tumbling window and key, in append mode."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", period), *keys)
    return rows.agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *item_stats(F.col("duration_ms"), "duration")).select(F.col("window.start").alias("bucket"), *keys, "count", "first_ts", "last_ts", *[f"duration_{k}" for k in ("max", "min", "mean", "std", "sum")])


PYTHON = {"long": int, "double": float, "string": str}
#: A key's waiting rows stand in so many lists, by slices of time that go round; a slice is an eighth of the time `late`.
LISTS, SLICES = 16, 8
#: The state store that lists, maps and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = (1 << 63) - 1


class _InOrder(StatefulProcessor):
    """Folds a key's rows in the order of time, once the watermark has passed them.

    A row that comes in is appended to the list of its slice of time; what a batch writes is its new rows, not those that wait. When
    the watermark passes rows of a slice, its list alone is read, and what still waits of it is put back. The smallest time of each
    list, the timer that is set and the memory of the fold are one small value."""

    def __init__(self, keys: Sequence[str], columns: Mapping[str, str], memory: Sequence[tuple[str, str]], out: Sequence[str], late_us: int, step: Callable, until: Callable, close: Callable):
        self.keys, self.columns, self.memory, self.out = list(keys), dict(columns), list(memory), list(out)
        self.width, self.step, self.until, self.close_rows = max(1, late_us // SLICES), step, until, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        small = ", ".join([*[f"m{k} bigint" for k in range(LISTS)], "timer bigint", "open boolean", *[f"h_{c} {k}" for c, k in self.memory]])
        self.meta = handle.getValueState("meta", small)
        self.lists = [handle.getListState(f"rows{k}", ", ".join(f"{c} {k2}" for c, k2 in self.columns.items())) for k in range(LISTS)]

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        casts, new = [PYTHON[k] for k in self.columns.values()], []
        for batch in rows:
            each = ([None if pd.isna(x) else cast(x) for x in batch[c]] for c, cast in zip(self.columns, casts, strict=True))
            new += zip(*each, strict=True)
        yield self._pass(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._pass(key, timerValues, [])

    def _pass(self, key: tuple, times, new: list[tuple]) -> pd.DataFrame:
        found = self.meta.get()
        least, timer, held = [_NEVER] * LISTS, None, None
        if found is not None:
            least, timer = [_NEVER if m is None else m for m in found[:LISTS]], found[LISTS]
            held = tuple(found[LISTS + 2 :]) if found[LISTS + 1] else None
        passed = times.getCurrentWatermarkInMs()
        waiting: dict[int, list[tuple]] = {}
        ready = [row for row in new if row[0] <= passed * 1000]
        for row in new:
            if row[0] > passed * 1000:
                waiting.setdefault(row[0] // self.width % LISTS, []).append(row)
        for k in range(LISTS):
            if least[k] <= passed * 1000:
                rows = [tuple(r) for r in self.lists[k].get()]
                ready += [r for r in rows if r[0] <= passed * 1000]
                rest = [r for r in rows if r[0] > passed * 1000]
                least[k] = min((r[0] for r in rest), default=_NEVER)
                if rest:
                    self.lists[k].put(rest)
                else:
                    self.lists[k].clear()
        for k, rows in waiting.items():
            self.lists[k].appendList(rows)
            least[k] = min(least[k], *(r[0] for r in rows))
        done: list[tuple] = []
        for row in sorted(ready, key=lambda row: [(x is not None, x) for x in row]):
            held, rows = self.step(held, row)
            done += rows
        if held is not None and self.until(held) is not None and self.until(held) <= passed * 1000:
            done, held = done + self.close_rows(held), None
        due = min([*least, *([self.until(held)] if held is not None and self.until(held) is not None else [])])
        wanted = max(-(-due // 1000), passed + 1) if due < _NEVER else None
        if wanted != timer:
            if timer is not None and timer > passed:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if held is None and all(m == _NEVER for m in least):
            self.meta.clear()
        else:
            self.meta.update((*[None if m == _NEVER else m for m in least], wanted, held is not None, *(held if held is not None else [None] * len(self.memory))))
        return pd.DataFrame([(*key, *row) for row in done], columns=[*self.keys, *self.out], dtype=object)


def _in_order(events: DataFrame, keys: Sequence[str], columns: Mapping[str, str], late: str, memory: str, out: str, step: Callable, until: Callable, close: Callable) -> DataFrame:
    """The rows of each key, as tuples of `columns` (names and kinds, the time in microseconds first), folded in their order.

    step(memory, row) gives the next memory and the rows that come out; until(memory) is the last time of a row that the
    memory may still take, None for ever; close(memory) gives the rows that come out once that time is past. The session's state
    stores are those of RocksDB from here on, which lists and timers need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = {c: k for c, k in events.dtypes if c in keys}
    whole = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], out])
    fields = [tuple(part.split(": ")) for part in memory.split(", ")]
    processor = _InOrder(keys, columns, fields, [part.split()[0] for part in out.split(", ")], round(pd.Timedelta(late).total_seconds() * 1e6), step, until, close)
    return events.filter("ts is not null").withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(processor, outputStructType=whole, outputMode="Append", timeMode="EventTime")


def _times(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """rows with columns of microseconds as times under new names."""
    return rows.select(*[F.timestamp_micros(c).alias(names[c]) if c in names else F.col(c) for c in rows.columns])


def stream_sessions(events: DataFrame, late: str = "10 minutes", orphan_after: float = 3600) -> DataFrame:
    """T2: begins, items and ends of sessions, as pair_sessions gives them; events (node_id, session_key, event_id, ts, type).

    A begin comes out once its end, another begin, or `orphan_after` seconds have passed; what comes later than that finds
    no open session (the batch operator has no such limit)."""
    id_kind = "long" if dict(events.dtypes)["event_id"] in ("tinyint", "smallint", "int", "bigint") else "string"
    begin_bit, item_bit, end_bit, single_bit, ignore_bit = (EVENT_TYPES[k] for k in ("SessionBegin", "SessionItem", "SessionEnd", "SingleInstance", "SessionIgnore"))
    wait = round(orphan_after * 1_000_000)

    def begun(held: tuple, orphan: bool) -> tuple:
        return held[1], held[0], held[2], str(held[1]), held[0], None, orphan

    def step(held: tuple | None, row: tuple) -> tuple:
        us, event, kind = row
        lost, bits, single = [], kind or 0, False
        if held and us > held[0] + wait:
            lost, held = [begun(held, True)], None
        if bits & begin_bit and bits & item_bit:
            kind = bits & ~((begin_bit if held else item_bit) | single_bit)
        elif bits & item_bit and bits & single_bit:
            kind, single = bits & ~(single_bit if held else item_bit), not held
        elif bits & item_bit and bits & ignore_bit and not bits & begin_bit and not held:
            return None, lost
        begin, end = bool((kind or 0) & begin_bit), bool((kind or 0) & end_bit)
        if begin:
            return (us, event, kind), [*lost, *([begun(held, True)] if held else [])]
        if not held:
            return None, [*lost, (event, us, kind, None, None, None, not single)]
        if end:
            return None, [begun(held, False), (event, us, kind, str(held[1]), held[0], (us - held[0]) / 1000.0, False)]
        return held, [(event, us, kind, str(held[1]), held[0], None, False)]

    rows = events.select("node_id", "session_key", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast(id_kind).alias("event"), F.col("type").cast("long").alias("kind"))
    out = f"event_id {id_kind}, us long, type long, session_id string, begin_us long, duration_ms double, orphaned boolean"
    rows = _in_order(rows, ["node_id", "session_key"], {"us": "long", "event": id_kind, "kind": "long"}, late, f"us: long, event: {id_kind}, kind: long", out, step, lambda held: held[0] + wait, lambda held: [begun(held, True)])
    return _times(rows, {"us": "ts", "begin_us": "ts_begin"})


def _runs(events: DataFrame, late: str, reach: int, anchored: bool, least_ms: float) -> DataFrame:
    # The memory: begin of the run, last begin, the end that counts for the reach, last end, number, sum and maximum of durations.
    def add(a: float | None, b: float | None) -> float | None:
        return (None if anchored else b if a is None else a) if a is None or b is None else a + b

    def close(held: tuple) -> list[tuple]:
        begin, _, _, end, n, total, high = held
        return [(begin, end, n, total, high)] if n > 1 and (not anchored or (total is not None and total >= least_ms)) else []

    def step(held: tuple | None, row: tuple) -> tuple:
        b, e, d = row
        if held and held[2] is not None and (held[0] if anchored else held[1]) < b <= held[2] + reach:
            begin, _, counts, _, n, total, high = held
            return (begin, b, counts if anchored else e, e, n + 1, add(total, d), max((x for x in (high, d) if x is not None), default=None)), []
        return (b, b, e, e, 1, d, d), close(held) if held else []

    rows = events.select("node_id", "ts", F.unix_micros("ts").alias("us"), F.unix_micros("ts_end").alias("end_us"), F.col("duration_ms").cast("double").alias("ms"))
    memory = "begin: long, last: long, reach: long, end: long, n: long, total: double, high: double"
    out = "begin_us long, end_us long, occurrences long, duration_sum double, duration_max double"
    until = lambda held: held[1] if held[2] is None else held[2] + reach
    rows = _in_order(rows, ["node_id"], {"us": "long", "end_us": "long", "ms": "double"}, late, memory, out, step, until, close)
    return _times(rows, {"begin_us": "run_begin", "end_us": "run_end"})


def stream_back_to_back(events: DataFrame, late: str = "10 minutes", tolerance_ms: float = 150) -> DataFrame:
    """T3: runs of events (node_id, ts, ts_end, duration_ms) that begin at most `tolerance_ms` after the one before ended."""
    return _runs(events, late, round(tolerance_ms * 1000), anchored=False, least_ms=0.0)


def stream_time_frame(events: DataFrame, late: str = "10 minutes", frame_ms: float = 300_000, least_ms: float = 75_000) -> DataFrame:
    """T4: windows anchored at their first event."""
    return _runs(events, late, round(frame_ms * 1000), anchored=True, least_ms=least_ms)


def stream_deltas(counters: DataFrame, late: str = "10 minutes", forget_after: float = 30 * 86_400) -> DataFrame:
    """T5: a cumulative counter (node_id, name, ts, value) as differences; a smaller value counts as it is, the first has none.

    A counter that is silent for `forget_after` seconds is forgotten and starts anew, so that state ends."""
    wait = round(forget_after * 1_000_000)

    def step(held: tuple | None, row: tuple) -> tuple:
        us, value = row
        last = held[1] if held and us <= held[0] + wait else None
        delta = None if last is None or value is None else value - last if value >= last else value
        return (us, value), [(us, delta)]

    rows = counters.select("node_id", "name", "ts", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    rows = _in_order(rows, ["node_id", "name"], {"us": "long", "value": "double"}, late, "us: long, value: double", "us long, delta double", step, lambda held: held[0] + wait, lambda held: [])
    return _times(rows, {"us": "ts"})


def stream_distinct_lines(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """T6: one of each set of equal lines of a node within the watermark; lines later than the watermark are dropped."""
    return lines.withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id", "src_file", "src_line", "message"])
