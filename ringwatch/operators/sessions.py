"""Sessions that are tied by keys, labels and look-ups of open sessions: a stack machine over each node's events in order."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import EVENT_TYPES

#: What a row may do with its key, and with its look-up value.
KEY_ACTIONS = ("auto", "add", "read", "delete", "read_remove")
LOOKUP_ACTIONS = ("label", "session", "read", "define", "delete", "stack", "tie_out", "append_tie_out")
BEGIN, ITEM, END, IGNORE, SINGLE = (EVENT_TYPES[n] for n in ("SessionBegin", "SessionItem", "SessionEnd", "SessionIgnore", "SingleInstance"))
ADDED = "session_id string, tie_out string, parents array<string>, ts_begin timestamp, duration_ms double, orphaned boolean, repair string"


@dataclass(slots=True)
class Event:
    """A session event that later events may be tied to."""

    event_id: str
    ts: int | None
    kind: int
    session_id: str
    parents: tuple[str, ...]
    tie_out: str | None
    begin: int | None
    keyspace: str | None
    table: str | None


class OpenSessions:
    """Open sessions by key, in the order in which their keys were added, and by label. Keys are also held sorted, so that the
    keys with a prefix are found without reading all of them."""

    def __init__(self):
        self.by_key: dict[str, Event] = {}
        self.place: dict[str, int] = {}
        self.keys: list[str] = []
        self.labels: dict[str, list[Event]] = {}
        self.count = 0

    def add(self, key: str, event: Event) -> None:
        if key not in self.by_key:
            self.count += 1
            self.place[key] = self.count
            insort(self.keys, key)
        self.by_key[key] = event

    def drop(self, key: str) -> bool:
        if self.by_key.pop(key, None) is None:
            return False
        del self.place[key], self.keys[bisect_left(self.keys, key)]
        return True

    def starting_with(self, prefix: str) -> list[str]:
        """The open keys with the prefix, in the order in which they were added."""
        found = []
        for k in range(bisect_left(self.keys, prefix), len(self.keys)):
            if not self.keys[k].startswith(prefix):
                break
            found.append(self.keys[k])
        return sorted(found, key=self.place.__getitem__)

    def remove(self, key: str, event: Event) -> None:
        """Close the key, or else the first open one that starts with it and is of the event's session."""
        if not self.drop(key):
            other = next((k for k in self.starting_with(key) if self.by_key[k].session_id == event.session_id), None)
            if other is not None:
                self.drop(other)

    def matching(self, pattern: re.Pattern) -> str | None:
        return next((k for k in self.by_key if pattern.search(k)), None)


@lru_cache(4096)
def _pattern(lookup: str | None) -> re.Pattern | None:
    """A look-up value with a # is a pattern, written without the #."""
    return re.compile(lookup.replace("#", "")) if lookup is not None and "#" in lookup else None


@lru_cache(4096)
def _actions(text: str | None) -> frozenset[str]:
    found = frozenset(a.strip().lower() for a in text.split("|")) if text else frozenset(("read", "session"))
    if not found <= set(LOOKUP_ACTIONS):
        raise ValueError(f"unknown look-up action in {text!r}: {', '.join(LOOKUP_ACTIONS)}")
    return found


@dataclass(slots=True)
class Row:
    key: str | None
    key_action: str
    lookup: str | None
    pattern: re.Pattern | None
    actions: frozenset[str]


def find(row: Row, state: OpenSessions) -> tuple[Event | None, str | None]:
    """The open session event that a row belongs to, and the row's tie-out: by its key, else by a look-up among the open keys, else
    among the labels, of which the top of the stack counts."""

    def tied(label: str | None, otherwise: str | None) -> str | None:
        if "append_tie_out" in row.actions and row.key is not None:
            return f"{row.lookup or ''},{row.key}"
        return label if "tie_out" in row.actions else otherwise

    event = tie = None
    if row.key is not None and row.key_action in ("auto", "read", "read_remove"):
        event, tie = state.by_key.get(row.key), row.key
        if row.lookup is not None:
            tie = tied(row.lookup, row.key)
    if event is not None or "read" not in row.actions:
        return event, tie
    if "session" in row.actions:
        if row.pattern is not None:
            tie = state.matching(row.pattern)
            event = state.by_key.get(tie) if tie is not None else None
        elif row.lookup is not None:
            event, tie = state.by_key.get(row.lookup), row.lookup
    if event is None and "label" in row.actions:
        if row.pattern is not None:
            label = next((k for k in state.labels if row.pattern.search(k)), None)
            tie = tied(label, label if row.key is None else row.key)
        else:
            label = row.lookup
            if label is not None:
                tie = tied(label, label if row.key is None else row.key)
        stack = state.labels.get(label) if label is not None else None
        event = stack[-1] if stack else None
    return event, tie


def update(row: Row, state: OpenSessions, event: Event) -> None:
    """What a row does to the open keys and labels."""
    if row.key is not None:
        action = row.key_action
        if action == "auto":
            action = "add" if event.kind & BEGIN else "delete" if event.kind & END else "read"
        if action == "add":
            state.add(row.key, event)
        elif action in ("delete", "read_remove"):
            state.remove(row.key, event)
    if row.pattern is None and row.lookup is not None:
        if "session" in row.actions:
            if "define" in row.actions:
                state.add(row.lookup, event)
            elif "delete" in row.actions:
                state.remove(row.lookup, event)
        if "label" in row.actions:
            if "define" in row.actions:
                stack = state.labels.setdefault(row.lookup, [])
                if "stack" not in row.actions:
                    stack.clear()
                stack.append(event)
            elif "delete" in row.actions and state.labels.get(row.lookup):
                state.labels[row.lookup].pop()
                if not state.labels[row.lookup]:
                    del state.labels[row.lookup]
    elif row.pattern is not None and "delete" in row.actions:
        if "label" in row.actions:
            for k in [k for k in state.labels if row.pattern.search(k)]:
                del state.labels[k]
        if "session" in row.actions:
            for k in [k for k in state.by_key if row.pattern.search(k)]:
                state.drop(k)


class Machine:
    """The fold over one node's events. step gives the added columns of a row and its type, or None for a row to leave out."""

    def __init__(self):
        self.open = OpenSessions()
        self.last_end: Event | None = None

    def step(self, event_id: str, ts: int | None, kind: int, row: Row, keyspace: str | None, table: str | None):
        if not kind & (BEGIN | ITEM | END | IGNORE):
            return kind, None, None, (), None, False, None
        found, tie = find(row, self.open)
        orphaned, repair = False, None
        if found is None:
            if kind & BEGIN:
                kind &= ~ITEM
                tie = row.key if row.key is not None else None if row.pattern else row.lookup
            elif kind & IGNORE:
                return None
            elif kind & SINGLE:
                return SINGLE, None, None, (), None, False, None
            else:
                orphaned = True
        else:
            kind &= ~SINGLE
            if kind & IGNORE:
                kind = kind & ~IGNORE | ITEM
            if kind & BEGIN and kind & ITEM:
                kind &= ~BEGIN
        session, parents, begin = (event_id if kind & BEGIN else None), (), (ts if kind & BEGIN else None)
        if found is not None:
            session, parents = found.session_id, found.parents + ((found.event_id,) if found.kind & BEGIN else ())
            if not kind & BEGIN:
                begin = found.begin
        if orphaned:
            other = self._repaired(kind, ts, tie if tie is not None else row.key, tie, keyspace, table)
            if other is not None:
                repair, found = other
                orphaned, session, begin, tie = False, found.session_id, found.begin, found.tie_out
                parents = found.parents + ((found.event_id,) if found.kind & BEGIN else ())
        event = Event(event_id, ts, kind, session if session is not None else event_id, parents, tie, begin, keyspace, table)
        if kind & END:
            self.last_end = event
        update(row, self.open, event)
        return kind, session, tie, parents, begin, orphaned, repair

    def _repaired(self, kind, ts, key, tie, keyspace, table) -> tuple[str, Event] | None:
        """The event that an orphan belongs to: the session end of its key at the very same time, as such lines are written in
        either order; for an end also the latest open session whose key starts with its tie-out and whose table (or, without one,
        keyspace) agrees."""
        last = self.last_end
        if last is not None and last.ts == ts and key is not None and key == last.tie_out:
            return "same_tick", last
        if kind & END and tie is not None:
            for k in reversed(self.open.starting_with(tie)):
                other = self.open.by_key[k]
                if keyspace is None or (table is None and keyspace == other.keyspace) or (table is not None and (keyspace, table) == (other.keyspace, other.table)):
                    return "open_prefix", other
        return None


def _fold(n_keys: int, schema: StructType):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, own = Machine(), None
        for b in batches:
            keys = [c.to_pylist() for c in b.columns[:n_keys]]
            need = [b.column(c).to_pylist() for c in ("event_id", "type", "session_key", "key_action", "lookup", "lookup_action", "keyspace", "table_name")]
            times = pc.cast(b.column("ts"), pa.int64()).to_pylist()
            kept, out = [], []
            for k, (event_id, kind, key, key_action, lookup, actions, keyspace, table) in enumerate(zip(*need, strict=True)):
                node = tuple(c[k] for c in keys)
                if node != own:
                    machine, own = Machine(), node
                row = Row(key, key_action or "auto", None if _pattern(lookup) else lookup, _pattern(lookup), _actions(actions))
                done = machine.step(str(event_id), times[k], kind or 0, row, keyspace, table)
                if done is not None:
                    kept.append(k)
                    out.append(done)
            if not kept:
                continue
            b = b.take(pa.array(kept, pa.int64()))
            kind, session, tie, parents, begin, orphaned, repair = map(list, zip(*out, strict=True))
            began = pa.array(begin, pa.int64()).cast(b.schema.field("ts").type)
            end = pa.array([bool(k & END) for k in kind])
            took = pc.if_else(end, pc.divide(pc.cast(pc.subtract(pc.cast(b.column("ts"), pa.int64()), pa.array(begin, pa.int64())), pa.float64()), 1000.0), None)
            added = dict(zip([*(part.split(" ")[0] for part in ADDED.split(", ")), "type"], [pa.array(session, pa.string()), pa.array(tie, pa.string()), pa.array(list(map(list, parents)), pa.list_(pa.string())), began, took, pa.array(orphaned), pa.array(repair, pa.string()), pa.array(kind, pa.int64())], strict=True))
            yield pa.RecordBatch.from_arrays([added[c] if c in added else b.column(c) for c in names], names)

    return run


def tie_sessions(events: DataFrame, keys: Sequence[str] = ("node_id",), order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Events with the session that each belongs to: session_id, tie_out, parents (begins around it, outermost first), ts_begin,
    duration_ms of ends, orphaned and repair.

    events (keys, event_id, ts, type, session_key; optional key_action, lookup, lookup_action, keyspace, table_name). key_action
    is one of KEY_ACTIONS; auto lets a begin add its key and an end close it. lookup is another key or a label, or a pattern
    if it holds a #; lookup_action joins LOOKUP_ACTIONS by '|', read|session where it is null. A session found makes a begin a
    nested one, with the session_id of the outer. Begin-or-item, single-or-item and ignored rows are resolved as pair_sessions
    does. Orphans are repaired where they can be (see Machine); begins that no end refers to are orphaned. Rows that are no
    session events pass through. The events' own columns of these names are replaced.

    What one row may read depends on all rows before it on its node, by pattern also on keys it doesn't name, so a node's events are
    one fold: a sorted stream, in memory its open sessions only. Nodes are folded in parallel; pair_sessions, which needs no
    look-ups, takes a session key's rows apart."""
    optional = {"key_action": "string", "lookup": "string", "lookup_action": "string", "keyspace": "string", "table_name": "string"}
    added = StructType.fromDDL(ADDED)
    given = [c for c in events.columns if c not in added.names]
    rest = [c for c in given if c not in (*keys, "type")]
    rows = events.select(*keys, *rest, F.col("type").cast("long").alias("type"), *[F.lit(None).cast(k).alias(c) for c, k in optional.items() if c not in given])
    schema = StructType([*rows.schema.fields, *added.fields])
    done = rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_fold(len(keys), schema), schema)
    ended = done.filter(F.col("type").bitwiseAND(F.lit(END)) != 0)
    # an end closes the begin around it, the outermost one, and the one whose time it took
    ended = ended.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(F.array_distinct(F.array(F.try_element_at("parents", F.lit(1)), F.try_element_at("parents", F.lit(-1))))).alias("_begin")).filter("_begin is not null").distinct()
    on = F.col("event_id").cast("string") == F.col("_begin")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    open_ = (F.col("type").bitwiseAND(F.lit(BEGIN)) != 0) & F.col("_begin").isNull()
    out = done.join(ended, on, "left").withColumn("orphaned", F.col("orphaned") | open_)
    return out.select(*given, *added.names)
