"""Wide tokens against Python's whole numbers, and look-ups in rings of both widths."""

import random

from pyspark.sql import functions as F

from ringwatch.functions import wide as Wd
from ringwatch.operators import joins as J


def randoms(r, n):
    edges = [0, 1, -1, Wd.WIDE_MIN, Wd.WIDE_MAX, (1 << 64) - 1, 1 << 64, -(1 << 64), -(1 << 64) - 1, (1 << 63) - 1, 1 << 63, 10**19, -(10**19), 10**38]
    return edges + [r.randrange(-(1 << r.randrange(1, 128)), 1 << r.randrange(1, 128)) for _ in range(n)]


def test_wide_tokens_are_whole_numbers(spark):
    r = random.Random(1)
    pairs = [(r.choice(x), r.choice(x)) for x in [randoms(r, 60)] for _ in range(400)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").withColumns({"x": Wd.wide_token(F.col("a")), "y": Wd.wide_token(F.col("b"))})
    rows = df.select("a", "b", "x", "y", (F.col("x") < F.col("y")).alias("less"), Wd.wide_text(F.col("x")).alias("back"), Wd.wide_text(Wd.wide_slots(F.col("x"), F.col("y"))).alias("slots")).collect()
    for row in rows:
        a, b = int(row.a), int(row.b)
        assert row.x.hi * 2**64 + int(row.x.lo) == a and row.back == str(a) and row.less == (a < b)
        assert int(row.slots) == (Wd.WIDE_MAX if a == b else b - a if a < b else b - Wd.WIDE_MIN + Wd.WIDE_MAX - a)
    odd = spark.createDataFrame([(x,) for x in [None, "", "x", "1.5", "--1", str(Wd.WIDE_MAX + 1), str(Wd.WIDE_MIN - 1), "9" * 39, " +007 ", "-0"]], "a string")
    assert [row[0] for row in odd.select(Wd.wide_text(Wd.wide_token(F.col("a")))).collect()] == [None] * 8 + ["7", "0"]


def brute(ring, token):
    return sorted(n for n, s, e in ring if (s < e and s < token <= e) or (s >= e and (token > s or token <= e)))


def test_lookups_in_rings_of_both_widths(spark):
    r = random.Random(2)
    for bits in (64, 128):
        low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        kind, as_is = ("long", int) if bits == 64 else ("string", str)
        tokens = [low, high, 0, -1, *[r.randrange(low, high) for _ in range(80)]]
        for shape in ("even", "crowded", "one"):
            ends = sorted({r.randrange(low, high) if shape == "even" else r.randrange(low >> 20, high >> 20) if shape == "crowded" else 5 for _ in range(40)})
            ring = [(f"n{k}", ends[k - 1], e) for k, e in enumerate(ends)]
            ring += [("over", low, low + 10), ("wide", -5, high)] if shape == "even" else []
            looked = tokens + [e + d for e in ends for d in (-1, 0, 1)]
            ranges = spark.createDataFrame([("d", n, as_is(s), as_is(e)) for n, s, e in ring], f"dc string, node_id string, start {kind}, end {kind}")
            df = spark.createDataFrame([(k, as_is(t)) for k, t in enumerate(looked)], f"k int, token {kind}")
            got = {}
            for row in J.tokens_containing(df, ranges).select("k", "node_id").collect():
                got.setdefault(row.k, []).append(row.node_id)
            assert {k: sorted(v) for k, v in got.items()} == {k: b for k, t in enumerate(looked) if (b := brute(ring, t))}


def test_a_large_ring_meets_few_ranges_a_token(spark):
    """Candidates of a token don't grow with the ring."""
    pairs = {}
    for n in (1_000, 100_000):
        step = (1 << 63) // n * 2
        ends = spark.range(n).selectExpr("'d' as dc", "cast(id as string) as node_id", f"(id - {n // 2}) * {step} + pmod(hash(id), {min(step // 4, 1 << 30)}) as end")
        from ringwatch.operators import windows as W

        ranges = W.ring_to_ranges(ends.withColumnRenamed("end", "token"))
        cut, widths = J._ring_cells(ranges)
        tokens = spark.range(500).selectExpr("id", "xxhash64(id) as token")
        looks = J._looking(tokens.withColumn("_token", F.col("token")), "_token", False, widths)
        pairs[n] = looks.join(cut, ["_width", "_cell"]).count()
        assert J.tokens_containing(tokens, ranges).count() == 500
    assert pairs[100_000] < 2 * pairs[1_000] < 500 * 40


def test_wide_tokens_are_compared_without_lambdas(spark):
    r = random.Random(3)
    numbers = sorted(set(randoms(r, 300)))
    df = spark.createDataFrame([(str(x),) for x in numbers], "a string")
    assert [int(row.a) for row in df.orderBy(Wd.wide_order(F.col("a"))).collect()] == numbers
    odd = spark.createDataFrame([(x,) for x in [None, "", "x", "1.5", "--1", str(Wd.WIDE_MAX + 1), str(Wd.WIDE_MIN - 1), "9" * 39, " +007 ", "-0"]], "a string")
    assert [row[0] and tuple(row[0]) for row in odd.select(Wd.wide_order(F.col("a"))).collect()] == [None] * 8 + [(0, 0, 7), (0, 0, 0)]
    ranges = spark.createDataFrame([("d", "n", "-5", "10")], "dc string, node_id string, start string, end string")
    found = J.tokens_containing(spark.createDataFrame([("7",), ("-5",), ("0",)], "token string"), ranges)
    assert sorted(row.token for row in found.collect()) == ["0", "7"] and "lambda" not in found._jdf.queryExecution().toString()
