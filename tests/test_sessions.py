"""Sessions by keys, labels and look-ups, and the repair of orphans."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from ringwatch.operators import events as E
from ringwatch.operators import joins as J
from ringwatch.operators import sessions as S
from ringwatch.schema import EVENT_TYPES

B, I, X, G, ONE = (EVENT_TYPES[n] for n in ("SessionBegin", "SessionItem", "SessionEnd", "SessionIgnore", "SingleInstance"))
START = datetime(2024, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None)
KIND = "node_id string, event_id string, ts timestamp, type long, session_key string, key_action string, lookup string, lookup_action string, keyspace string, table_name string"


def at(ms):
    return START + timedelta(milliseconds=ms)


#: A flush is written by two threads: the one that asks for it names the table, the writer too. Compactions keep to their thread.
FLUSH_RULES = [
    {"tag": "compact", "message": "^Compacting ", "type": B, "session_key": "thread"},
    {"tag": "compacted", "message": "^Compacted ", "type": X, "session_key": "thread"},
    {"tag": "ask", "message": "^Enqueuing flush of ", "parse": [r"flush of (?P<table>\w+)"], "type": B | I, "session_key": "thread", "key_action": "read", "lookup": "props['table']", "lookup_action": "define|label|stack"},
    {"tag": "write", "message": "^Writing Memtable-", "parse": [r"Memtable-(?P<table>\w+)@"], "type": I, "lookup": "props['table']", "lookup_action": "read|label"},
    {"tag": "done", "message": "^Completed flushing ", "parse": [r"flushing \S*/(?P<table>\w+)-[0-9a-f]+/"], "type": X, "lookup": "props['table']", "lookup_action": "read|delete|label"},
    {"tag": "handoff", "message": "^Started hinted", "parse": [r"IP: /(?P<ip>\S+)"], "type": B, "lookup": "props['ip']", "lookup_action": "define|session"},
    {"tag": "handed", "message": "^Finished hinted", "parse": [r"endpoint /(?P<ip>\S+)"], "type": X, "lookup": "props['ip']", "lookup_action": "read|delete|session"},
]
LOG = [
    ("Compaction:3211", 0, "Compacting [a]"), ("Compaction:3211", 100, "Enqueuing flush of progress: 1315 on-heap"), ("Writer:8011", 120, "Writing Memtable-progress@1461(0.1KiB)"), ("Writer:8011", 121, "Completed flushing /d/progress-55080ab0/x (0.000KiB)"),
    ("Validation:800", 200, "Enqueuing flush of push_device: 22028 on-heap"), ("Writer:8011", 200, "Writing Memtable-push_device@12(6KiB)"), ("Writer:8011", 240, "Completed flushing /d/push_device-10986041/y (1KiB)"),
    ("Entropy:1", 300, "Enqueuing flush of push_device: 1 on-heap"), ("Stream", 301, "Enqueuing flush of push_device: 2 on-heap"), ("Writer:8012", 302, "Writing Memtable-push_device@3(2KiB)"), ("Writer:8012", 303, "Completed flushing /d/push_device-10986041/z (0KiB)"), ("Writer:8011", 310, "Completed flushing /d/push_device-10986041/w (0KiB)"),
    ("Hints:2", 400, "Started hinted handoff for host: h with IP: /10.1.37.0"), ("Hints:3", 410, "Finished hinted handoff of 8 rows to endpoint /10.1.37.0"), ("Compaction:3211", 500, "Compacted 4 sstables"),
]


def test_flushes_by_label_compactions_by_key(spark):
    rows = [("n", f"e{k:02}", at(ms), "INFO", thread, "F.java", message) for k, (thread, ms, message) in enumerate(LOG)]
    df = E.classify_events(spark.createDataFrame(rows, "node_id string, event_id string, ts timestamp, level string, thread string, src_file string, message string"), FLUSH_RULES)
    got = {r.event_id: r for r in S.tie_sessions(df).collect()}
    assert len(got) == len(LOG) and not any(r.orphaned for r in got.values())
    # the flush inside the compaction is an item of it; its writer finds it by the label
    assert [got[f"e{k:02}"].session_id for k in (0, 1, 2, 3, 14)] == ["e00"] * 5 and got["e14"].duration_ms == 500 and got["e03"].parents == ["e00"]
    assert [got[f"e{k:02}"].session_id for k in (4, 5, 6)] == ["e04"] * 3 and got["e06"].duration_ms == 40
    # two open flushes of one table: the top of the stack ends first
    assert got["e09"].session_id == got["e10"].session_id == "e08" and got["e11"].session_id == "e07" and got["e11"].duration_ms == 10
    assert got["e13"].session_id == "e12" and got["e13"].duration_ms == 10 and got["e13"].tie_out == "10.1.37.0"


class Plain:
    """The same rules, written as plain look-ups in lists of everything that is open."""

    def __init__(self):
        self.open, self.labels, self.end, self.closed = [], [], None, set()

    def get(self, key):
        return next((e for k, e in self.open if k == key), None)

    def put(self, key, e):
        for n, (k, _) in enumerate(self.open):
            if k == key:
                self.open[n] = (key, e)
                return
        self.open.append((key, e))

    def close(self, key, e):
        if self.get(key) is not None:
            self.open = [p for p in self.open if p[0] != key]
            return
        other = next((k for k, o in self.open if k.startswith(key) and o["session"] == e["session"]), None)
        self.open = [p for p in self.open if other is None or p[0] != other]

    def step(self, event_id, ts, kind, key, action, lookup, actions, ks, table):
        if not kind & (B | I | X | G):
            return {"id": event_id, "kind": kind, "session": None, "tie": None, "parents": (), "begin": None, "orphan": False, "repair": None}
        acts = (actions or "read|session").split("|")
        fits = None
        if lookup and "#" in lookup:
            import re

            fits, lookup = re.compile(lookup.replace("#", "")).search, None
        tied = lambda label, other: f"{lookup or ''},{key}" if "append_tie_out" in acts and key is not None else label if "tie_out" in acts else other
        found = tie = None
        action = action or "auto"
        if key is not None and action in ("auto", "read", "read_remove"):
            found, tie = self.get(key), key if lookup is None else tied(lookup, key)
        if found is None and "read" in acts:
            if "session" in acts:
                if fits:
                    tie = next((k for k, _ in self.open if fits(k)), None)
                    found = self.get(tie)
                elif lookup is not None:
                    found, tie = self.get(lookup), lookup
            if found is None and "label" in acts:
                if fits:
                    label = next((k for k, _ in self.labels if fits(k)), None)
                    tie = tied(label, key if key is not None else label)
                else:
                    label = lookup
                    tie = tied(label, key if key is not None else label) if label is not None else tie
                found = next((e for k, s in self.labels if k == label for e in s[-1:]), None)
        orphan, repair = False, None
        if found is None:
            if kind & B:
                kind, tie = kind & ~I, key if key is not None else lookup
            elif kind & G:
                return None
            elif kind & ONE:
                return {"id": event_id, "kind": ONE, "session": None, "tie": None, "parents": (), "begin": None, "orphan": False, "repair": None}
            else:
                orphan = True
        else:
            kind &= ~ONE
            kind = kind & ~G | I if kind & G else kind
            kind = kind & ~B if kind & B and kind & I else kind
        e = {"id": event_id, "ts": ts, "kind": kind, "session": event_id if kind & B else None, "tie": tie, "parents": (), "begin": ts if kind & B else None, "ks": ks, "table": table}
        for cause in ("found", "same_tick", "open_prefix"):
            if cause == "same_tick" and orphan and self.end and self.end["ts"] == ts and (tie if tie is not None else key) is not None and (tie if tie is not None else key) == self.end["tie"]:
                found = self.end
            elif cause == "open_prefix" and orphan and found is None and kind & X and tie is not None:
                for k, o in reversed(self.open):
                    if k.startswith(tie) and (ks is None or (table is None and ks == o["ks"]) or (table is not None and (ks, table) == (o["ks"], o["table"]))):
                        found = o
                        break
            elif cause != "found":
                continue
            if found is not None and not (cause == "found" and orphan):
                e |= {"session": found["sid"], "parents": found["parents"] + ((found["id"],) if found["kind"] & B else ())}
                if not kind & B:
                    e["begin"] = found["begin"]
                if orphan:
                    e["tie"], repair, orphan = found["tie"], cause, False
                break
        e["orphan"], e["repair"] = orphan, repair
        e["sid"] = e["session"] or event_id
        shadow = e | {"session": e["sid"]}
        if kind & X:
            self.end = shadow | {"sid": e["sid"]}
        if key is not None:
            act = ("add" if kind & B else "delete" if kind & X else None) if action == "auto" else action
            if act == "add":
                self.put(key, shadow)
            elif act in ("delete", "read_remove"):
                self.close(key, shadow)
        if fits is None and lookup is not None:
            if "session" in acts and "define" in acts:
                self.put(lookup, shadow)
            elif "session" in acts and "delete" in acts:
                self.close(lookup, shadow)
            if "label" in acts and "define" in acts:
                stack = next((s for k, s in self.labels if k == lookup), None)
                if stack is None:
                    self.labels.append((lookup, stack := []))
                if "stack" not in acts:
                    stack.clear()
                stack.append(shadow)
            elif "label" in acts and "delete" in acts:
                for _, s in [p for p in self.labels if p[0] == lookup]:
                    s.pop()
                self.labels = [p for p in self.labels if p[1]]
        elif fits is not None and "delete" in acts:
            if "label" in acts:
                self.labels = [p for p in self.labels if not fits(p[0])]
            if "session" in acts:
                self.open = [p for p in self.open if not fits(p[0])]
        return e


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_equal_a_plain_fold(spark, seed):
    r = random.Random(seed)
    actions = [None, "read|session", "read|label", "define|label", "define|label|stack", "read|delete|label", "define|session", "read|delete|session", "read|label|tie_out", "read|session|label|append_tie_out", "delete|session", "delete|label"]
    keys = ["a", "a,1", "a,2", "ab", "b", "b,1", "c"]
    rows = []
    for k in range(900):
        kind = r.choice([B, B | I, I, X, X, I | ONE, I | G, ONE, G])
        lookup = r.choice([None, None, "l1", "l2", "a", "^a#", "^l#"])
        rows.append((r.choice("mn"), f"{k:05}", at(r.choice([k, k - k % 7])), kind, r.choice([None, *keys]), r.choice([None, None, "auto", "add", "read", "delete", "read_remove"]), lookup, r.choice(actions), r.choice([None, "k1", "k2"]), r.choice([None, "t1", "t2"])))
    expected = {}
    for node in "mn":
        plain, out = Plain(), []
        for row in sorted((x for x in rows if x[0] == node), key=lambda x: (x[2], x[1])):
            e = plain.step(*row[1:])
            if e is not None:
                out.append((e, row[2]))
        closed = {p for e, _ in out if e["kind"] & X for p in (e["parents"][:1] + e["parents"][-1:])}
        for e, ts in out:
            begin = e["begin"]
            expected[e["id"]] = (e["kind"], e["session"], e["tie"], e["parents"], begin, (ts - begin).total_seconds() * 1000 if e["kind"] & X and begin is not None else None, e["orphan"] or bool(e["kind"] & B and e["id"] not in closed), e["repair"])
    got = {x.event_id: (x.type, x.session_id, x.tie_out, tuple(x.parents), x.ts_begin, x.duration_ms, x.orphaned, x.repair) for x in S.tie_sessions(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    assert set(got) == set(expected)
    assert [(k, got[k], expected[k]) for k in sorted(got) if got[k] != expected[k]][:3] == []
    assert "open_prefix" in {x[7] for x in got.values()}


def test_the_query_equals_the_plain_fold(spark):
    from pathlib import Path

    from ringwatch.plans import event_queries as Q

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("the driver's tables are not here")
    rows = Q.tied_events(spark, sf).collect()
    want, closed = {}, {}
    for node in sorted({r.node_id for r in rows}):
        plain = Plain()
        for r in sorted((r for r in rows if r.node_id == node), key=lambda r: (r.ts, r.event_id)):
            e = plain.step(str(r.event_id), r.ts, r.type, r.session_key, None, r.lookup, r.lookup_action, r.keyspace, r.table_name)
            want[r.event_id] = (e["session"], e["tie"], ",".join(e["parents"]), e["orphan"], e["kind"])
            if e["kind"] & X:
                closed |= {int(p): True for p in (e["parents"][:1] + e["parents"][-1:])}
    got = {r.event_id: (r.session_id, r.tie_out, r.parents, r.orphaned, r.type) for r in Q.QUERIES["tie_sessions"](spark, sf).collect()}
    assert got == {k: (*w[:3], w[3] or bool(w[4] & B and k not in closed), w[4]) for k, w in want.items()} and len(got) == len(rows)


def test_an_item_at_the_time_of_its_end_is_of_that_session(spark):
    rows = [("n", "1", at(0), B, "a"), ("n", "2", at(10), X, "a"), ("n", "3", at(10), I, "a"), ("n", "4", at(11), I, "a")]
    got = {r.event_id: (r.session_id, r.orphaned, r.repair) for r in S.tie_sessions(spark.createDataFrame(rows, "node_id string, event_id string, ts timestamp, type long, session_key string")).collect()}
    assert got == {"1": ("1", False, None), "2": ("1", False, None), "3": ("1", False, "same_tick"), "4": (None, True, None)}


def test_clashing_columns_no_rows_and_unknown_actions(spark):
    df = spark.createDataFrame([("n", 1, at(0), B, "s", "mine", 7.0), ("n", 2, at(5), X, "s", "mine", 7.0), (None, 3, None, None, None, None, None)], "node_id string, event_id long, ts timestamp, type long, session_key string, session_id string, duration_ms double")
    got = {r.event_id: (r.session_id, r.duration_ms) for r in S.tie_sessions(df).collect()}
    assert got == {1: ("1", None), 2: ("1", 5.0), 3: (None, None)}
    assert S.tie_sessions(df.filter("false")).collect() == []
    with pytest.raises(Exception, match="unknown look-up action"):
        S.tie_sessions(df.selectExpr("*", "'x' as lookup", "'find' as lookup_action")).collect()


def test_same_tick_and_open_prefix(spark):
    rows = [
        ("n", 1, 0, X, "a", None, None), ("n", 2, 0, B, "a", None, None),  # the end stands before its begin
        ("n", 3, 10, B, "b", None, None), ("n", 4, 20, X, "b", None, None), ("n", 5, 20, X, "b", None, None), ("n", 6, 20, I, "b", None, None),  # again at the same time
        ("n", 7, 30, B, "c,1", "k", "t"), ("n", 8, 31, B, "c,2", "k", "u"), ("n", 9, 32, B, "c,3", "k", "t"), ("n", 10, 33, X, "c,3", "k", "t"),
        ("n", 11, 40, X, "c", "k", "t"), ("n", 12, 41, X, "c", "k", None), ("n", 13, 42, X, "c", None, None), ("n", 14, 43, X, "c", "k", "w"), ("n", 15, 44, X, "d", None, None),
        ("n", 16, 50, X, "c,2", "k", "u"), ("n", 17, 60, X, "c", "k", "u"), ("m", 18, 60, X, "c", None, None),
    ]
    df = spark.createDataFrame([(n, k, at(t), kind, key, ks, tab) for n, k, t, kind, key, ks, tab in rows], "node_id string, event_id long, ts timestamp, type long, session_key string, keyspace string, table_name string")
    done = J.repair_orphans(J.pair_sessions(df))
    got = {r.event_id: (r.session_id, r.duration_ms, r.orphaned, r.repair) for r in done.collect()}
    assert got[1] == ("2", 0.0, False, "same_tick") and got[2] == ("2", None, False, "same_tick")
    assert got[5] == ("3", 10.0, False, "same_tick") and got[6] == ("3", None, False, "same_tick")
    assert got[11] == ("7", 10.0, False, "open_prefix")  # c,3 is closed, c,2 is of another table
    assert got[12] == ("8", 10.0, False, "open_prefix") and got[13] == ("8", 11.0, False, "open_prefix")  # the keyspace agrees; nothing has to
    assert got[14] == (None, None, True, None) and got[15][2] and got[17] == (None, None, True, None) and got[18][2]
    assert sorted(r.event_id for r in J.orphan_events(done).collect()) == [7, 14, 15, 17, 18]


def test_a_busy_key_is_linear(spark):
    """200,000 rows of one session key: the next mark is a running value of the reversed order."""
    df = spark.range(200_000).selectExpr("'n' as node_id", "'s' as session_key", "id as event_id", "timestamp_millis(id) as ts", f"CAST(CASE id % 4 WHEN 0 THEN {B} WHEN 3 THEN {X} ELSE {I} END AS long) as type")
    got = J.pair_sessions(df).selectExpr("count(*)", "count_if(orphaned)", "count(duration_ms)", "sum(duration_ms)").first()
    assert tuple(got) == (200_000, 0, 50_000, 150_000.0)
