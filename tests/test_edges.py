"""Nulls, empty tables, ties and columns whose names operators use inside; cases that once lost data."""

import datetime as dt
import json
import random
import statistics

from pyspark.sql import functions as F

from ringwatch.functions import columns as C
from ringwatch.operators import events as E
from ringwatch.operators import joins as J
from ringwatch.operators import stats as S
from ringwatch.operators import windows as W
from ringwatch.plans import flows
from ringwatch.schema import EVENT_TYPES, NODE_STATES
from ringwatch.sources import json as Js
from ringwatch.sources import text as T

START = dt.datetime(2024, 1, 1)


def hour(x):
    return START + dt.timedelta(hours=x)


def test_overlaps_in_the_order_of_processing(spark):
    kinds = "node_id string, is_debug boolean, seq int, path string, file_min timestamp, file_max timestamp, status string"
    files = [("n", 0, 10), ("n", 20, 30), ("n", 5, 25), ("n", 40, 50), ("n", 30, 35), ("n", 36, 45), ("n", 21, 22), ("n", 60, 500), ("n", 55, 600), ("m", 5, 25), ("n", None, 3)]
    df = spark.createDataFrame([(n, False, k, f"f{k}", None if a is None else hour(a), hour(b), "mine") for k, (n, a, b) in enumerate(files)], kinds)
    got = {r.seq: (r.status, r.used_min and (r.used_min - START).total_seconds() / 3600, r.used_max and (r.used_max - START).total_seconds() / 3600) for r in J.trim_overlaps(df, order=["seq"]).collect()}
    assert got == {0: ("new", 0, 10), 1: ("new", 20, 30), 2: ("error", None, None), 3: ("new", 40, 50), 4: ("trimmed", 30, 35), 5: ("trimmed", 36, 40), 6: ("within", None, None), 7: ("new", 60, 500), 8: ("new", 55, 600), 9: ("new", 5, 25), 10: ("new", None, 3)}
    assert J.trim_overlaps(df.limit(0)).collect() == []


def test_overlaps_are_those_of_a_plain_loop(spark):
    r = random.Random(8)
    files = [(k, a := r.randrange(300), a + r.randrange(40)) for k in range(120)]
    expected = {}
    for k, a, z in files:
        before = [f for f in files if f[0] < k]
        after, until = [f[2] for f in before if f[1] <= a <= f[2]], [f[1] for f in before if f[1] < z < f[2]]
        expected[k] = "within" if any(f[1] <= a and z <= f[2] for f in before) else "error" if after and until else "trimmed" if after or until else "new"
    df = spark.createDataFrame([("n", False, k, hour(a), hour(z)) for k, a, z in files], "node_id string, is_debug boolean, seq int, file_min timestamp, file_max timestamp")
    assert {x.seq: x.status for x in J.trim_overlaps(df, order=["seq"]).collect()} == expected


def test_network_exceptions(spark):
    names = ["java.io.IOException: Connection reset", "io.netty.channel.unix.Errors$NativeIoException: x", "ClosedChannelException", "a.ChannelException", "b.TimeoutException", None]
    df = spark.createDataFrame([(START, "n", x, ["o"] if k == 1 else None) for k, x in enumerate(names)], "ts timestamp, node_id string, exception string, assoc_nodes array<string>")
    assert sorted((r.node_id, r.detected_by) for r in W.network_state_changes(df).collect()) == [("n", None)] * 3 + [("o", "n")]


def test_leaves_of_any_depth(spark, tmp_path):
    document = {"a": {"b": {"c": {"d": {"e": 1.50}}}}, "list": [1, {"x": 2}], "none": None, "text": "7", "yes": True, "empty": {}}
    (tmp_path / "10.0.0.9").mkdir()
    (tmp_path / "10.0.0.9/cpu.json").write_text(json.dumps(document))
    (tmp_path / "10.0.0.9/bad.json").write_text("{")
    got = {r.attr: (r.num_value, r.str_value) for r in Js.read_json_facts(spark, str(tmp_path / "*")).collect()}
    assert got == {"a.b.c.d.e": (1.5, None), "list": (None, '[1,{"x":2}]'), "none": (None, None), "text": (7.0, None), "yes": (None, "true"), "empty": (None, "{}")}
    odd = spark.createDataFrame([("n", None), ("n", ""), ("n", "[1]"), (None, "{}"), (None, '{"k":null}')], "node_id string, v string")
    assert [(r.node_id, r.attr, r.num_value) for r in Js.json_facts(odd).collect()] == [(None, "k", None)]


def test_all_columns_of_a_pool(spark):
    line = "ReadStage   " + "   ".join(str(k) for k in range(30))
    lines = spark.createDataFrame([("n", "/p", 0, 0, line)], "node_id string, path string, block int, seq int, line string")
    got = T.read_pool_stats(lines).collect()
    assert [(r.attr.rpartition(".")[2], r.num_value) for r in got] == list(zip(("Active", "Pending", "Completed", "Blocked", "All time blocked"), range(5), strict=True))


def test_info_lines(spark):
    text = ["ID : abc", "Load  : 1.5 GiB", "Version : 6.7.1", "", "no value :", "Heap Memory (MB) : 10.00 / 20.00"]
    lines = spark.createDataFrame([("n", x) for x in text], "node_id string, line string")
    assert [(r.attr, r.num_value, r.str_value) for r in T.read_info(lines).collect()][:3] == [("ID", None, "abc"), ("Load", 1536.0, None), ("Version", None, "6.7.1")]


def test_own_columns_with_the_names_used_inside(spark):
    begin, end = EVENT_TYPES["SessionBegin"], EVENT_TYPES["SessionEnd"]
    rows = [("n", "s", 1, hour(0), begin, "a"), ("n", "s", 2, hour(1), end, "b"), (None, None, 3, None, None, None)]
    df = spark.createDataFrame(rows, "node_id string, session_key string, event_id long, ts timestamp, type long, x string")
    clash = df.selectExpr("*", "x as mark", "x as seen", "x as next", "x as same_tick", "x as nth", "7.0D as duration_ms")
    got = {r.event_id: r for r in J.pair_sessions(clash).collect()}
    assert got[2].session_id == "1" and got[2].duration_ms == 3.6e6 and (got[2].mark, got[2].seen, got[2].next, got[2].nth) == ("b",) * 4
    assert "same_tick" in J.orphan_events(J.repair_orphans(J.pair_sessions(clash))).columns
    assert {r.nth for r in E.cap_events(clash, 1, ["node_id"], ["event_id"]).collect()} == {"a", None}
    names = spark.createDataFrame([("ks", "t", "1")], "keyspace string, table_name string, id string")
    assert [(r.name, r.keyspace_found) for r in J.resolve_names(df.selectExpr("x as name", "'ks.T' as raw_name"), names).filter("name = 'a'").collect()] == [("a", "ks")]
    hosts = spark.createDataFrame([("H1", "n1", "d")], "name string, node_id string, dc string")
    assert J.resolve_nodes(df.selectExpr("x as host_name", "'h1' as address"), hosts).filter("host_name = 'b'").first().node_found == "n1"
    ranges = spark.createDataFrame([("d", "n", -5, 5), ("d", "m", 5, -5)], "dc string, node_id string, start long, end long")
    tokens = spark.createDataFrame([(0, "c", "p"), (9, "c", "p")], "token long, cell string, part string")
    assert sorted((r.token, r.node_id, r.cell, r.part) for r in J.tokens_containing(tokens, ranges).collect()) == [(0, "n", "c", "p"), (9, "m", "c", "p")]
    totals = spark.createDataFrame([(1.0, "x"), (3.0, "y")], "a double, total_a string")
    assert sorted((r.a_pct, r.total_a) for r in S.percent_of_total(totals, ["a"]).collect()) == [(0.25, "x"), (0.75, "y")]
    states = spark.createDataFrame([("n", hour(0), NODE_STATES["Started"], None, None, "q")], "node_id string, ts timestamp, state long, detected_by string, duration_ms double, nth string")
    assert W.node_state_timeline(states).first().nth == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "node_id string, session_key string, event_id long, ts timestamp, type long, class long, message string, level string, thread string, src_file string")
    assert J.pair_sessions(df).collect() == E.classify_events(df, flows.RULES).collect() == E.classify_events(df, []).collect() == []
    assert S.percent_of_total(spark.createDataFrame([], "a double"), ["a"]).collect() == []


def test_statistics_of_two_columns(spark):
    r = random.Random(3)
    rows = [(k % 5, None if r.random() < 0.4 or k % 5 == 4 else r.gauss(100, 3), None if r.random() < 0.4 or k % 5 > 2 else r.gauss(0, 5)) for k in range(80)]
    got = spark.createDataFrame(rows, "k int, a double, b double").groupBy("k").agg(*E.two_stats(F.col("a"), F.col("b"), "x")).collect()
    for g in got:
        every = [v for k, a, b in rows for v in (a, b) if k == g.k and v is not None]
        found = (g.x_max, g.x_min, g.x_mean, g.x_std, g.x_sum)
        expected = (max(every), min(every), statistics.fmean(every), statistics.pstdev(every), sum(every)) if every else (None,) * 5
        assert all(x == y if x is None or y is None else abs(x - y) < 1e-9 for x, y in zip(found, expected, strict=True))


def test_the_first_rule_and_its_first_pattern_win(spark):
    rules = [{"tag": "a", "message": "x", "parse": [r"x(?P<n>\d)y", r"(?P<w>[a-z]+)$"], "session_key": "thread"}, {"tag": "b", "message": "x", "class": 4}, {"tag": "c", "level": "WARN"}]
    lines = spark.createDataFrame([("x1y", "INFO", "t"), ("x abc", "INFO", "t"), ("x 1", "INFO", "t"), ("q", "WARN", None), ("q", "INFO", None), (None, None, None)], "message string, level string, thread string")
    got = [(r.rule, r.tag, r["class"], r.props, r.session_key) for r in E.classify_events(lines.coalesce(1), rules).collect()]
    assert got == [(0, "a", 0, {"n": "1"}, "t"), (0, "a", 0, {"w": "abc"}, "t"), (1, "b", 4, {}, None), (2, "c", 0, {}, None), (None,) * 5, (None,) * 5]


def test_thresholds(spark):
    text = json.dumps([{"AttrName": "SSTable count", "MinTrigger": 0.5, "AttrValue": {"CalcType": "Normal", "Threshold": 30, "Weight": 1, "WeightFactor": 1, "PenaltyFactor": 0.6}, "MinValue": None}])
    assert C.read_thresholds(text) == {"sstables": {"trigger": 0.5, "attr": dict(threshold=30.0, weight=1.0, factor=1.0, penalty=0.6, kind="over")}}
    assert set(C.THRESHOLDS) == set(C.THRESHOLD_NAMES.values())
    stats = spark.createDataFrame([("d", "k", "t", "n", "SSTable count", 15.0), ("d", "k", "t", "n", "SSTable count", 45.0), ("d", "k", "u", "n", "Partition large", 50.0)], "dc string, keyspace string, table_name string, node_id string, attr string, num_value double")
    rows = {r.table_name: r for r in S.tagged_tables_node(stats, {v: k for k, v in C.THRESHOLD_NAMES.items()}).collect()}
    assert abs(rows["t"].sstables_weight - ((1.5 * 0.6 + 1) + 0.4 * 0.5 + (1 * 0.2 + 0.3))) < 1e-9 and rows["t"].flagged and rows["u"].partition_weight == 0.5 and not rows["u"].flagged


def test_lists_of_sizes(spark):
    df = spark.createDataFrame([("n", "k", "t", float(v), v * 2.0) for v in (3, 1, 3, 2)] + [(None, None, None, None, 5.0)], "node_id string, keyspace string, table_name string, partition_mib double, required_mib double")
    assert [(r.node_id, r.n, r["values"]) for r in S.partition_size_list(df).collect()] == [("n", 4, [1.0, 2.0, 3.0])]
    assert sorted((str(r.keyspace), r.n, r["values"]) for r in S.insufficient_space_list(df).collect()) == [("None", 1, [5.0]), ("k", 4, [2.0, 4.0, 6.0])]


def test_unhandled_lines_name_their_exceptions(spark):
    extra = ["java.lang.RuntimeException: boom", "\tat a.B.c(B.java:1)", "Caused by: java.io.IOException: disk"]
    rows = [(None, "ERROR", "boom", extra), (None, "WARN", "odd", []), (None, "WARN", None, None), (None, "INFO", "x", extra), (3, "ERROR", "x", extra)]
    lines = spark.createDataFrame(rows, "rule int, level string, message string, extra array<string>")
    assert [(r.message, r.exception) for r in E.unhandled_events(lines).collect()] == [("boom", "RuntimeException=>IOException"), ("odd", None), (None, None)]
    assert "exception" not in E.unhandled_events(lines.drop("extra")).columns


def test_index_names(spark):
    names = spark.createDataFrame([("ks", "T", "id1"), ("other", "t", None), ("ks", "solo", None)], "keyspace string, table_name string, id string")
    objects = spark.createDataFrame([("ks", "ix", "index", "T"), ("ks", "mv", "view", "solo"), ("other", "mv", "view", "t"), ("ks", "lost", "table", None)], "keyspace string, name string, kind string, base_table string")
    raw = ["KS.t", "t", "solo", "id1", "ix", "ks.ix", "ks.T.ix", "T.ix", "mv", "ks.mv", "other.mv", "lost", None, ""]
    rows = J.resolve_names(spark.createDataFrame([(r, "x") for r in raw], "raw_name string, object_found string"), names, objects=objects).collect()
    index, found = ("ks", "T", "ix", "index"), {r.raw_name: (r.keyspace_found, r.table_found, r.object_found, r.kind_found) for r in rows}
    none = (None,) * 4
    assert found == {
        "KS.t": ("ks", "T", None, None), "t": none, "solo": ("ks", "solo", None, None), "id1": ("ks", "T", None, None), "ix": index, "ks.ix": index, "ks.T.ix": index, "T.ix": index, "mv": none,
        "ks.mv": ("ks", "solo", "mv", "view"), "other.mv": ("other", "t", "mv", "view"), "lost": none, None: none, "": none,
    }
    assert len(rows) == len(raw)


def test_ranges_containing(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    ranges = [("a", low, -5), ("b", -5, 5), ("c", 5, 5), ("d", 100, -100)]
    checks = [(-6, -5), (-5, 5), (-9, 9), (5, 6), (99, 101), (high - 1, low), (0, None), (None, 0)]
    rows = J.ranges_containing(spark.createDataFrame(checks, "check_start long, check_end long"), spark.createDataFrame(ranges, "node_id string, start long, end long")).collect()

    def holds(s, e, a, z):
        inside = lambda x: x is not None and (s < x <= e if s < e else x > s or x <= e)
        return inside(z) or (inside(a) and a != e)

    want = sorted((str(c), n) for c in checks for n, s, e in ranges if holds(s, e, *c))
    assert sorted((str((r.check_start, r.check_end)), r.node_id) for r in rows) == want


def test_workload_ring(spark):
    text = (
        "Note: Ownership information does not include topology\nAddress  DC  Rack  Workload  Status  State  Load  Owns  Token\n   3074457345618258602\n10.0.0.1  d  r1  Analytics(JT)  Up  Normal  316.61 GB  16.67%  -9223372036854775808   \n"
        "Server ID  Address  DC  Rack  Workload  Graph  Status  State  Load  Owns  VNodes  Health [0,1]\n 3C-A8-2A-17-08-08  10.0.0.2  d  r1  Search  yes  Down  Normal  1 GB  ?  32  0.90  \n10.0.0.3 d r1 Other no Up Normal ? ? 1 0.2\nbroken line"
    )
    lines = spark.createDataFrame([("/x", "n", 0, k, line) for k, line in enumerate(text.split("\n"))], "path string, node_id string, block long, seq long, line string")
    rows = {r.address: r for r in T.read_workload_ring(lines).collect()}
    assert sorted(rows) == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]
    one, two, three = (rows[f"10.0.0.{k}"] for k in (1, 2, 3))
    assert (one.kinds, one.role, int(one.token), one.tokens, one.health, one.server_id) == (["Analytics"], "JT", -(1 << 63), None, None, None)
    assert (two.kinds, two.status, two.tokens, two.token, two.health) == (["Search", "Graph", "MultiInstance"], "Down", 32, None, 0.9)
    assert (three.kinds, three.load_mib, three.owns) == ([], None, None)


def test_summaries_of_nothing(spark):
    stats = spark.createDataFrame([], "dc string, node_id string, keyspace string, table_name string, attr string, num_value double")
    events = spark.createDataFrame([], "dc string, node_id string, keyspace string, class long, state long")
    nodes = spark.createDataFrame([("d", "n1", None, None, None), ("d", "n2", "Up", ["Graph"], 0.5)], "dc string, node_id string, status string, kinds array<string>, data_used_pct double")
    row = S.datacenter_summary(nodes, stats, events, states=events.select("dc", "state")).first()
    assert (row.nodes, row.nodes_up, row.nodes_unknown, row.graph_nodes, row.other_nodes, row.starts) == (2, 1, 1, 1, 2 - 1, 0)
    assert (row.data_used_pct_max_node, row.data_used_pct_min_node, row.reads_total) == ("n2", "n2", None)
    columns = spark.createDataFrame([("k", "t", "c", None, None), ("k", "t", "d", "map<text, frozen<my_type>>", "static")], "keyspace string, table_name string, name string, cql_type string, kind string")
    assert S.column_feature_counts(columns).first().asDict() == {"keyspace": "k", "columns": 2, "collections": 1, "blobs": 0, "static_columns": 1, "frozen": 1, "tuples": 0, "user_types": 1}
    cells = spark.createDataFrame([("n", "k", "t", 1, 3), ("n", "k", "t", 0, 0), ("n", "k", "t", 2, 2)], "node_id string, keyspace string, table_name string, tombstones long, live_cells long")
    assert [(r.n, r["values"]) for r in S.tombstone_ratio_list(cells).collect()] == [(2, [0.25, 0.5])]


def test_rule_file(spark, tmp_path):
    rules = [
        {"order": 2, "tag": "late", "message": "x"},
        {"order": 1, "tag": "stats", "message": "^stats", "parse": ["node (?$<ip>) of $<!word>"], "repeat": {"sizes": "size=(\\d+)", "ip": "(z)"}, "pairs": "(\\w+):(\\w+)", "type": "SessionBegin|SessionItem", "class": "GC", "session_key": ["props['id']", "thread"]},
    ]
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    got = E.read_rules(spark, str(tmp_path / "rules.json"), {"ip": "[0-9.]+", "word": "\\w+"})
    assert [r["tag"] for r in got] == ["stats", "late"] and got[0]["parse"] == ["node (?P<ip>[0-9.]+) of \\w+"]
    lines = spark.createDataFrame([("stats node 1.2 of a size=3 size=4 id:7 k:a k:b ip:9", "t1"), ("stats node 5 of b", "t2"), ("x", "t3"), (None, "t4")], "message string, thread string").withColumns({c: F.lit(None).cast("string") for c in ("level", "src_file")})
    rows = {r.thread: r for r in E.classify_events(lines, got).collect()}
    assert rows["t1"].props == {"ip": "1.2", "sizes": "3,4", "id": "7", "k": "a"} and rows["t1"].session_key == "7"
    assert rows["t2"].props == {"ip": "5"} and rows["t2"].session_key == "t2" and rows["t2"].type == EVENT_TYPES["SessionBegin"] | EVENT_TYPES["SessionItem"]
    assert (rows["t3"].tag, rows["t4"].tag) == ("late", None)
    assert E.expand_pattern("(?$<no>) $<!no>", {}) == "(?$<no>) $<!no>"


def test_session_kinds_that_depend(spark):
    b, i, e, one, skip = (EVENT_TYPES[k] for k in ("SessionBegin", "SessionItem", "SessionEnd", "SingleInstance", "SessionIgnore"))
    types = [i | one, i | skip, b | i, b | i, i | one, i | skip, e, i | skip, i | one, i, b | i, e, None]
    events = spark.createDataFrame([("n", "s", k, START + dt.timedelta(seconds=k), t) for k, t in enumerate(types)], "node_id string, session_key string, event_id long, ts timestamp, type long")
    rows = [(r.event_id, r.type, r.session_id, r.orphaned) for r in J.pair_sessions(events).orderBy("event_id").collect()]
    assert rows == [(0, one, None, False), (2, b, "2", False), (3, i, "2", False), (4, i, "2", False), (5, i | skip, "2", False), (6, e, "2", False), (8, one, None, False), (9, i, None, True), (10, b, "10", False), (11, e, "10", False), (12, None, None, True)]


def test_value_samples_of_a_hot_key(spark):
    """Ranks counted in slices of the values equal those of one sorted list, ties, null keys and a key of one value included."""
    import random
    from collections import Counter

    r = random.Random(8)
    rows = [("hot", r.choice([r.gauss(0, 9), float(r.randrange(40))])) for _ in range(4000)] + [(None, float(k % 7)) for k in range(500)] + [("one", 5.0)] * 300 + [("few", 1.0), ("few", None), ("hot", float("inf"))]
    got: dict = {}
    for x in S.bounded_value_sample(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], limit=200, band=30).collect():
        got.setdefault(x.k, []).append((x.v, x.n))
    for key in ("hot", None, "one", "few"):
        mine = sorted(v for k, v in rows if k == key and v is not None)
        n = len(mine)
        middle = (n - 30) // 2
        want = set(mine) if n < 200 else {*mine[:30], *mine[middle : middle + 30], *mine[-30:]}
        assert Counter(got[key]) == Counter((v, n) for v in want)


def test_overlaps_are_found_without_pairs(spark):
    """Files that all lie over each other, some equal, against each other one by one; no join of files with files."""
    r = random.Random(5)
    files = [(r.choice(["n", "m", None]), f"p{k % 150:03}", a := r.randrange(60), a + r.choice([0, 1, 2, 5, 40, 400])) for k in range(400)]
    df = spark.createDataFrame([(n, p, START + dt.timedelta(hours=a), START + dt.timedelta(hours=z)) for n, p, a, z in files], "node_id string, path string, file_min timestamp, file_max timestamp")
    hours = lambda t: t and (t - START).total_seconds() / 3600
    for order in (["path", "file_min"], ["file_min", "path"]):
        out = J.trim_overlaps(df, ["node_id"], order)
        got = sorted((str(x.node_id), x.path, hours(x.file_min), hours(x.file_max), x.status, hours(x.used_min), hours(x.used_max)) for x in out.collect())
        expected = []
        rank = lambda f: (f[1], f[2]) if order[0] == "path" else (f[2], f[1])
        for n, p, a, z in files:
            before = [e for e in files if e[0] == n and rank(e) < rank((n, p, a, z))]
            after = max((e[3] for e in before if e[2] <= a <= e[3]), default=None)
            until = min((e[2] for e in before if e[2] < z < e[3]), default=None)
            status = "within" if after is not None and after >= z else "error" if None not in (after, until) else "new" if after is until is None else "trimmed"
            used = (a if after is None else after, z if until is None else until) if status in ("new", "trimmed") else (None, None)
            expected.append((str(n), p, a, z, status, *used))
        assert got == sorted(expected, key=lambda x: x[:5])
        assert "_day" not in out._jdf.queryExecution().toString()
