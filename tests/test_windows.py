"""Ordered operators against plain folds over random sequences."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ringwatch.operators import joins as J
from ringwatch.operators import windows as W
from ringwatch.schema import EVENT_TYPES

START = dt.datetime(2024, 1, 1)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def fold(events, reach, anchored, least=0.0):
    runs, run = [], []
    for b, e in sorted(events):
        base = (run[0] if anchored else run[-1]) if run else None
        if run and base[0] < b <= base[1] + reach:
            run.append((b, e))
        else:
            runs.append(run)
            run = [(b, e)]
    return sorted((r[0][0], r[-1][1], len(r), sum(e - b for b, e in r)) for r in [*runs, run] if len(r) > 1 and sum(e - b for b, e in r) >= least)


events = st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 200)), min_size=0, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(events)
def test_runs_are_the_folds(spark, found):
    pairs = [(b, b + d) for b, d in found]
    df = spark.createDataFrame([("n", at(b), at(e), float(e - b)) for b, e in pairs], "node_id string, ts_begin timestamp, ts_end timestamp, duration_ms double")
    ms = lambda t: round((t - START).total_seconds() * 1000)
    got = sorted((ms(r.run_begin), ms(r.run_end), r.occurrences, r.duration_sum) for r in W.gc_back_to_back(df).collect())
    assert got == fold(pairs, 150, False)
    # slices as short as a frame, so that frames reach over them
    for slice_ms in (W.FRAME_SLICE_MS, 250):
        got = sorted((ms(r.run_begin), ms(r.run_end), r.occurrences, r.duration_sum) for r in W.gc_time_frame(df, frame_ms=300, least_ms=100, slice_ms=slice_ms).collect())
        assert got == fold(pairs, 300, True, 100)


def test_slices_carry_over(spark):
    """Lag and running sum over slices of time equal those of one window, null keys, null times and ties included."""
    random.seed(9)
    rows = [(random.choice(["a", "b", None]), None if k % 50 == 0 else at(random.randrange(20_000)), k, random.choice([None, 1, 5])) for k in range(600)]
    df = spark.createDataFrame(rows, "node_id string, ts timestamp, nth long, v long")
    key = lambda r: (str(r[0]), r[1] is not None, r[1] or START, r[2])
    want, last, total = {}, {}, {}
    for r in sorted(rows, key=key):
        total[r[0]] = total.get(r[0], 0) + (r[3] or 0)
        want[r[2]] = (last.get(r[0]), total[r[0]])
        last[r[0]] = (r[2], r[3])
    from pyspark.sql import functions as F

    for slice_ms in (10, 700, 1e9):
        got = W.sliced_lag(df, ["node_id"], ["ts", "nth"], ["nth", "v"], "before", slice_ms)
        got = W.sliced_sum(got, ["node_id"], ["ts", "nth"], F.coalesce("v", F.lit(0)), "total", slice_ms)
        assert {r.nth: (tuple(r.before) if r.before else None, r.total) for r in got.collect()} == want


def test_continuous_runs(spark):
    day = lambda x: START + dt.timedelta(days=x)
    cases = {
        "one long": ([(0, 5)], [(1, "DurationThresholdMet")]), "one short": ([(0, 1)], []), "two": ([(0, 3), (3.001, 5)], [(2, "DurationThresholdMet")]),
        "three": ([(0, 2), (2.001, 4), (4.001, 5)], [(3, "ContinuousThresholdMet")]), "with a copy": ([(0, 5), (0, 5), (1, 2)], [(1, "ContinuousThresholdMet")]),
        "gap": ([(0, 5), (7, 8), (8.001, 13)], [(1, "ContinuousThresholdMet"), (2, "DurationThresholdMet")]), "short, gap, long": ([(0, 1), (3, 8)], [(1, "DurationThresholdMet")]),
    }
    rows = [(n, False, f"{n}{k}", day(a), day(z), 10, 100) for n, (files, _) in cases.items() for k, (a, z) in enumerate(files)]
    df = spark.createDataFrame(rows, "node_id string, is_debug boolean, path string, used_min timestamp, used_max timestamp, items long, size long")
    got = W.log_continuous_runs(df).orderBy("node_id", "run_begin").collect()
    assert {n: [(r.files, r.kind) for r in got if r.node_id == n] for n in cases} == {n: want for n, (_, want) in cases.items()}
    assert all(r["items"] == 10 * r.files and r["size"] == 100 * r.files for r in got)


def test_log_file_gaps(spark):
    h = lambda x: START + dt.timedelta(hours=x)
    files = [(0, 10), (0, 10), (2, 4), (4, 20), (15, 18), (15, 19), (21, 30), (30, 30.5), (30.6, 31)]
    df = spark.createDataFrame([("n", False, h(a), h(b)) for a, b in files], "node_id string, is_debug boolean, used_min timestamp, used_max timestamp")
    got = [(r.kind, None if r.gap_minutes is None else round(r.gap_minutes)) for r in W.log_file_gaps(df).orderBy("used_min", "used_max").collect()]
    assert got == [("Normal", 0), ("Duplicated", None), ("Duplicated", None), ("OverLapping", None), ("Duplicated", None), ("OverLapping", None), ("Gap", 120), ("OverLapping", None), ("Normal", 6)]


def test_delta_after_restart(spark):
    df = spark.createDataFrame([("n", t, float(v)) for t, v in enumerate((5, 9, 9, 2, 4))], "node_id string, t int, v double")
    assert [r.delta for r in W.delta_running_total(df, "v", ["node_id"], ["t"]).orderBy("t").collect()] == [None, 4.0, 0.0, 2.0, 2.0]


def test_split_at_restarts(spark):
    df = spark.createDataFrame([("p", at(0), at(100), 7, [(at(20), at(30)), (at(50), at(60))]), ("q", at(0), at(9), 3, None)], "path string, used_min timestamp, used_max timestamp, items long, restarts array<struct<min:timestamp,max:timestamp>>")
    got = [(r.path, r.part, r.used_min, r.used_max, r["items"]) for r in W.split_at_restarts(df).orderBy("path", "part").collect()]
    assert got == [("p", 0, at(0), at(20), 0), ("p", 1, at(30), at(50), 0), ("p", 2, at(60), at(100), 7), ("q", 0, at(0), at(9), 3)]


def test_ring_wraps(spark):
    df = spark.createDataFrame([("d", "a", -10), ("d", "b", 0), ("d", "c", 10)], "dc string, node_id string, token long")
    ranges = W.ring_to_ranges(df)
    assert sorted((r.node_id, r.start, r.end) for r in ranges.collect()) == [("a", 10, -10), ("b", -10, 0), ("c", 0, 10)]
    tokens = spark.createDataFrame([(t,) for t in (-11, -10, -9, 0, 10, 11)], "token long")
    assert sorted((r.token, r.node_id) for r in J.tokens_containing(tokens, ranges).collect()) == [(-11, "a"), (-10, "a"), (-9, "b"), (0, "b"), (10, "c"), (11, "a")]


def test_sessions_and_orphans(spark):
    b, i, e = EVENT_TYPES["SessionBegin"], EVENT_TYPES["SessionItem"], EVENT_TYPES["SessionEnd"]
    rows = [(k, at(k * 10), t) for k, t in enumerate([e, b, i, e, b, b, e, i, b])]
    df = spark.createDataFrame([("n", "s", k, t, x) for k, t, x in rows], "node_id string, session_key string, event_id long, ts timestamp, type long")
    got = {r.event_id: (r.session_id, r.duration_ms, r.orphaned) for r in J.pair_sessions(df).collect()}
    assert got == {0: (None, None, True), 1: ("1", None, False), 2: ("1", None, False), 3: ("1", 20.0, False), 4: ("4", None, True), 5: ("5", None, False), 6: ("5", 10.0, False), 7: (None, None, True), 8: ("8", None, True)}
    assert sorted(r.event_id for r in J.orphan_events(J.repair_orphans(J.pair_sessions(df))).collect()) == [0, 4, 7, 8]


@pytest.mark.parametrize("n", [0, 1, 30])
def test_trim_overlaps_covers_once(spark, n):
    random.seed(n)
    files = [(f"p{k}", a := random.randrange(500), a + random.randrange(1, 90)) for k in range(n)]
    df = spark.createDataFrame([("n", False, p, at(a), at(z)) for p, a, z in files], "node_id string, is_debug boolean, path string, file_min timestamp, file_max timestamp")
    used = sorted((r.used_min, r.used_max) for r in J.trim_overlaps(df).collect() if r.status != "within")
    assert all(x[1] <= y[0] for x, y in zip(used, used[1:]))
    ms = lambda t: round((t - START).total_seconds() * 1000)
    assert {t for a, z in used for t in range(ms(a), ms(z))} == {t for _, a, z in files for t in range(a, z)}


def test_parents_are_found_beyond_many_short_sessions(spark):
    random.seed(4)
    rows = [("n", 0, 0, 9_000_000), (None, 1, 5, 9_000), (None, 2, 6, 8_000)] + [("n", 10 + k, 1000 + 50 * k, 1020 + 50 * k) for k in range(200)]
    rows += [("m", 300 + k, a := random.randrange(90_000), a + int(10 ** random.uniform(0, 5))) for k in range(150)]
    rows += [("m", 500, 7, None), ("m", 501, 90_000, 80_000), ("m", 502, 90_000, 99_000), ("m", 503, 90_000, 99_000)]
    df = spark.createDataFrame([(n, k, f"s{k}", at(a), None if z is None else at(z)) for n, k, a, z in rows], "node_id string, event_id long, session_id string, ts_begin timestamp, ts_end timestamp")
    got = {r.event_id: r.parents for r in W.session_parent_chain(df).collect()}
    key = lambda r: (r[2], -r[3], r[1])
    whole = sorted((r for r in rows if r[3] is not None), key=key)
    expected = {r[1]: [f"s{y[1]}" for y in whole if r[3] is not None and y[0] == r[0] and y[2] <= y[3] and key(y) < key(r) and y[3] >= r[3]] for r in rows}
    assert expected[209] == ["s0"] and expected[2] == ["s1"]
    # an event that ends before it begins has the parents open at its begin only
    expected[501] = [p for p in expected[501] if next(y for y in whole if f"s{y[1]}" == p)[3] >= 90_000]
    assert got == expected


def test_time_frame_of_a_node_without_a_pause(spark):
    pairs = [(k * 100, k * 100 + 60) for k in range(60_000)]
    df = spark.range(60_000).selectExpr("'n' as node_id", "timestamp_micros(1704067200000000 + id * 100000) as ts_begin", "timestamp_micros(1704067200060000 + id * 100000) as ts_end", "60.0D as duration_ms")
    rows = W.gc_time_frame(df, frame_ms=300, least_ms=100)
    ms = lambda t: round((t - START).total_seconds() * 1000)
    assert sorted((ms(r.run_begin), ms(r.run_end), r.occurrences, r.duration_sum) for r in rows.collect()) == fold(pairs, 300, True, 100)
    assert "collect_list" not in rows._jdf.queryExecution().toString()
    got = W.gc_time_frame(df, frame_ms=300, least_ms=100, slice_ms=10_000).collect()
    assert sorted((ms(r.run_begin), ms(r.run_end), r.occurrences, r.duration_sum) for r in got) == fold(pairs, 300, True, 100)
    assert all((r.duration_min, r.duration_mean, r.duration_std) == (60.0, 60.0, 0.0) for r in got)


def test_groups_are_numbered_without_one_window_over_all(spark):
    from ringwatch.operators import stats as S

    df = spark.createDataFrame([("a", "y", "n", "[1, 2/1]"), ("b", "x", "n", "[3]"), ("a", "x", "m", "[1]"), ("a", "x", "n", "[2]")], "keyspace string, table_name string, node_id string, lcs string")
    rows = S.lcs_levels_report(df)
    assert sorted((r.keyspace, r.table_name, r.group_no) for r in rows.collect()) == [("a", "x", 1), ("a", "x", 1), ("a", "y", 2), ("b", "x", 3)]
    assert "dense_rank" not in rows._jdf.queryExecution().toString()


def test_parents_are_put_together_without_shuffling_pairs(spark):
    """Sessions open in layers and many times over: the list of an event is made in its slice, pairs aren't collected by a shuffle."""
    rows = [("n" if k % 3 else None, k, (k // 40) * 500, (k // 40) * 500 + (k % 7) * 20_000 - 300) for k in range(3_000)]
    df = spark.createDataFrame([(n, k, f"s{k}", at(a), at(z)) for n, k, a, z in rows], "node_id string, event_id long, session_id string, ts_begin timestamp, ts_end timestamp")
    out = W.session_parent_chain(df)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r.event_id: r.parents for r in out.collect()}
    key = lambda r: (r[2], -r[3], r[1])
    for node in ("n", None):
        own = sorted((r for r in rows if r[0] == node), key=key)
        for k, x in enumerate(own):
            assert got[x[1]] == [f"s{y[1]}" for y in own[:k] if y[3] >= max(y[2], x[2], x[3])]
    assert W.session_parent_chain(df.limit(0)).collect() == []


def test_time_frame_of_events_written_by_many_tasks(spark):
    """What slices are told is so little that Spark broadcasts it; a slice's events still meet in one task."""
    df = spark.range(20_000).selectExpr("'n' as node_id", "timestamp_micros(1704067200000000 + id div 3 * 100000) as ts_begin", "timestamp_micros(1704067200060000 + id div 3 * 100000) as ts_end", "60.0D as duration_ms")
    ms = lambda t: round((t - START).total_seconds() * 1000)
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}  # broadcast when sizes are known, as with large tables
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = W.gc_time_frame(df.repartition(7), frame_ms=300, least_ms=100, slice_ms=50_000).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((ms(r.run_begin), ms(r.run_end), r.occurrences, r.duration_sum) for r in got) == fold([(k // 3 * 100, k // 3 * 100 + 60) for k in range(20_000)], 300, True, 100)
