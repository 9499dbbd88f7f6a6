from pyspark.sql import functions as F

from ringwatch.functions import columns as C
from ringwatch.schema import EVENT_CLASSES, EVENT_TYPES


def values(spark, kind, rows, *exprs):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [tuple(r) if len(exprs) > 1 else r[0] for r in df.select(*exprs).collect()]


def test_normalize_units(spark):
    v = C.normalize_units(F.col("x"))
    rows = ["10 MB", "1.5 GB", "512 KiB", "0.15 ms", "2 s", "7%", "NaN ms", "3 GB/sec", "12", "many", None, "1,024 bytes", "5 things"]
    got = values(spark, "string", rows, v["value"], v["unit"])
    assert got == [(10.0, "MiB"), (1536.0, "MiB"), (0.5, "MiB"), (0.15, "ms"), (2000.0, "ms"), (0.07, "%"), (None, "ms"), (3072.0, "MiB/sec"), (12.0, ""), (None, ""), (None, None), (1024 / 1048576, "MiB"), (5.0, "things")]


def test_flags(spark):
    c = EVENT_CLASSES
    got = values(spark, "long", [c["GC"] | c["Warning"], c["Repair"] | c["GC"], None], C.has_flag(F.col("x"), c["GC"]), C.has_flag(F.col("x"), c["GC"] | c["Repair"]), C.log_class_name(F.col("x")))
    assert got == [(True, False, "GC"), (True, True, "GC,Repair"), (False, False, "")]
    assert len(set(EVENT_TYPES.values())) == len(EVENT_TYPES) and max(EVENT_CLASSES.values()) < 1 << 63


def test_properties(spark):
    p = F.col("x")
    got = values(spark, "map<string,string>", [{"a": "5", "b": "-3", "c": "2 MB"}, {}, {"a": "word"}], C.prop_number(p, "a"), C.prop_positive(p, "b"), C.prop_non_negative(p, "a"), C.prop_long(p, "b"), C.prop_unit(p, "c"))
    assert got == [(5.0, None, 5.0, -3, 2.0), (-1.0, None, None, 0, -1.0), (-1.0, None, None, 0, -1.0)]


def test_threshold_weight(spark):
    w = lambda kind, penalty: C.threshold_weight(F.col("x"), F.lit(1.5), F.lit(1.0), F.lit(0.25), F.lit(penalty), F.lit(kind))
    got = values(spark, "double", [1.0, 1.5, 1.9, None], w("over", 0.0), w("over", 0.5), w("over", 1.0))
    assert [[None if v is None else round(v, 3) for v in r] for r in got] == [[0.167, 0.167, 0.167], [0.25, 0.75, 1.25], [0.25, 0.883, 1.517], [None, None, None]]


def test_attr_weight_of_one_value(spark):
    rules = {"attr": dict(threshold=2.0), "min": dict(threshold=1.0), "avg": dict(threshold=4.0)}
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 0.5, 1.0)], "h double, l double, m double")
    assert [r[0] for r in df.select(C.attr_weight(rules, *map(F.col, "hlm"))).collect()] == [0.5, 1.0 + 0.5 + 0.25]
    assert df.select(C.attr_weight({"avg": dict(threshold=4.0)}, *map(F.col, "hlm"))).first()[0] == 0.25


def test_exception_path(spark):
    text = "java.lang.RuntimeException: a\n\tat x.Y.z(Y.java:1)\nCaused by: java.io.IOException: b\nCaused by: java.io.IOException: c\n... 2 more"
    assert values(spark, "string", [text, "nothing", None], C.exception_path_text(C.exception_path(F.col("x")))) == ["RuntimeException=>IOException", "", None]


def test_sstable_to_table(spark):
    v = C.sstable_to_table(F.col("x"))
    rows = ["/data/ks1/t-0123456789abcdef0123456789abcdef/mc-1-big-Data.db", "/d/ks-t-ka-12-Data.db", "/d/x.log", None]
    assert values(spark, "string", rows, v["keyspace"], v["table_name"]) == [("ks1", "t"), ("ks", "t"), (None, None), (None, None)]


def test_group_key_is_independent_of_list_order(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "n array<string>")
    key = C.group_key_fields(F.lit(EVENT_CLASSES["GC"] | EVENT_CLASSES["Error"] | EVENT_CLASSES["Orphaned"]), F.lit("old"), F.col("n"), F.array().cast("array<string>"), {"Tag": F.col("n")})
    assert {r[0] for r in df.select(key).collect()} == {"GC(old) [a, b] Tag{a,b}"}


def test_lcs_levels(spark):
    v = C.lcs_parse(F.col("x"))
    got = values(spark, "string", ["[1, 12/10, 85]", "[0, 0]", "none", None], v["actual"], v["ideal"], v["splits"], v["max_level"], v["first_split"])
    assert got == [(98, 96, 1, 2, 1), (0, 0, 0, None, None), (None,) * 5, (None,) * 5]


def test_token_slots(spark):
    df = spark.createDataFrame([(-5, 10), (9223372036854775800, -9223372036854775800), (7, 7)], "s long, e long")
    assert [int(r[0]) for r in df.select(C.token_slots(F.col("s"), F.col("e"))).collect()] == [15, 15, (1 << 64) - 1]


def test_config_values(spark):
    assert values(spark, "string", ['  "Abc  D" ', "x", None], C.config_value_normalize(F.col("x"))) == ["abc d", "x", None]
