"""Column expressions: flags, units, properties, names, weights, tokens. All are built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EVENT_CLASSES, LEVEL_MASK, ORPHANED

#: Sizes in MiB, times in ms, as written by the tools (decimal names mean binary sizes).
SIZE_MIB = {"bit": 1 / 8 / 1048576, "b": 1 / 1048576, "byte": 1 / 1048576, "bytes": 1 / 1048576, "kb": 1 / 1024, "kib": 1 / 1024, "mb": 1.0, "mib": 1.0, "gb": 1024.0, "gib": 1024.0, "tb": 1048576.0, "tib": 1048576.0, "pb": 1073741824.0, "pib": 1073741824.0}
TIME_MS = {"ns": 1e-6, "us": 1e-3, "micros": 1e-3, "usec": 1e-3, "ms": 1.0, "millis": 1.0, "s": 1e3, "sec": 1e3, "secs": 1e3, "second": 1e3, "seconds": 1e3, "min": 6e4, "mins": 6e4, "minutes": 6e4, "h": 3.6e6, "hr": 3.6e6, "hrs": 3.6e6, "hours": 3.6e6, "d": 8.64e7, "day": 8.64e7, "days": 8.64e7}


def has_flag(flags: Column, mask: int, all_bits: bool = True) -> Column:
    """Whether all bits (or any bit) of the mask are set; null flags give false."""
    hit = flags.cast("long").bitwiseAND(F.lit(mask))
    return F.coalesce(hit == mask if all_bits else hit != 0, F.lit(False))


def flag_names(flags: Column, names: Mapping[str, int], without: int = 0) -> Column:
    """The names of the set bits, comma separated in bit order; bits in `without` are left out."""
    each = [F.when(has_flag(flags, bit), F.lit(name)) for name, bit in sorted(names.items(), key=lambda x: x[1]) if not bit & without]
    return F.array_join(F.array_compact(F.array(*each)), ",")


def log_class_name(flags: Column) -> Column:
    """The event class as text, without level bits."""
    return flag_names(flags, EVENT_CLASSES, LEVEL_MASK)


def _factor(unit: Column, table: Mapping[str, float]) -> Column:
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), unit)


def normalize_units(text: Column) -> Column:
    """struct(value, unit) of texts such as '10 MB', '0.15 ms', '7%', 'NaN ms', '3 MB/sec'.

    Sizes become MiB, times ms, sizes per time MiB/sec, percentages fractions; other units stay as written. NaN,
    texts without a number and versions such as 1.2.3 give a null value.
    """
    pattern = r"^([+-]?[0-9][0-9,]*\.?[0-9]*(?:[eE][+-]?[0-9]+)?)"

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        """f of a value that is computed once, however often f reads it."""
        return F.transform(F.array(value), f)[0]

    def parts(x: Column) -> Column:
        rest = F.when(x["number"] != "", F.substring(x["text"], F.length(x["number"]) + 1, F.length(x["text"]))).when(x["text"].startswith("NaN"), F.substring(x["text"], F.lit(4), F.length(x["text"]))).otherwise("")
        return F.struct(F.regexp_replace(x["number"], ",", "").try_cast("double").alias("number"), F.lower(F.trim(F.substring_index(rest, "\n", 1))).alias("unit"))

    def factors(x: Column) -> Column:
        per = F.split(x["unit"], "/")
        top, low = F.trim(F.element_at(per, 1)), F.trim(F.try_element_at(per, F.lit(2)))
        number = F.when(~x["unit"].startswith("."), x["number"])
        return F.struct(number.alias("number"), x["unit"].alias("unit"), low.isNotNull().alias("per"), _factor(top, SIZE_MIB).alias("size"), _factor(x["unit"], TIME_MS).alias("time"), _factor(low, TIME_MS).alias("low"))

    def scaled(x: Column) -> Column:
        number, unit, per, size, time = x["number"], x["unit"], x["per"], x["size"], x["time"]
        rate, whole = per & size.isNotNull(), size.isNotNull() & ~per
        value = F.when(unit == "%", number / 100).when(rate, number * size / (x["low"] / 1000.0)).when(whole, number * size).when(time.isNotNull(), number * time).otherwise(number)
        name = F.when(unit == "%", "%").when(rate, "MiB/sec").when(whole, "MiB").when(time.isNotNull(), "ms").otherwise(unit)
        return F.struct(value.alias("value"), name.alias("unit"))

    matched = bound(F.trim(text), lambda t: F.struct(t.alias("text"), F.regexp_extract(t, pattern, 1).alias("number")))
    return F.when(text.isNotNull(), bound(bound(bound(matched, parts), factors), scaled))


def prop_number(props: Column, key: str, default: float = -1.0) -> Column:
    """A numeric property, or the default where it is missing or not a number."""
    return F.coalesce(F.try_element_at(props, F.lit(key)).try_cast("double"), F.lit(float(default)))


def prop_positive(props: Column, key: str) -> Column:
    """A property above zero, else null (missing reads as -1)."""
    v = prop_number(props, key)
    return F.when(v > 0, v)


def prop_non_negative(props: Column, key: str) -> Column:
    v = prop_number(props, key)
    return F.when(v >= 0, v)


def prop_long(props: Column, key: str) -> Column:
    """A whole-number property; missing reads as 0."""
    return F.coalesce(F.try_element_at(props, F.lit(key)).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def prop_unit(props: Column, key: str) -> Column:
    """A property with a unit, normalised; missing reads as -1."""
    return F.coalesce(normalize_units(F.try_element_at(props, F.lit(key)))["value"], F.lit(-1.0))


def exception_path(text: Column) -> Column:
    """array<string> of the exception classes of a nested stack trace, outermost first, equal neighbours merged."""
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("at ") & ~x.startswith("..."))
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"(?i)^caused by:\s*", ""), r"(?i);\s*nested exception is\s*")))
    names = F.transform(parts, lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:Exception|Error|Throwable|Failure)\w*)(?![\w.]*[(])", 1))
    names = F.transform(F.filter(names, lambda x: x != ""), lambda x: F.element_at(F.split(x, r"\."), -1))
    return F.aggregate(names, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) == x), a).otherwise(F.concat(a, F.array(x))))


def exception_path_text(path: Column) -> Column:
    return F.array_join(path, "=>")


def sstable_to_table(path: Column) -> Column:
    """struct(keyspace, table_name) of an SSTable file path; null where the path isn't one."""
    pattern = r"([^/\\]+)[/\\]([^/\\]+?)-[0-9a-fA-F]{32}[/\\](?:[^/\\]+[/\\])*[^/\\]+-Data\.db"
    old = r"(?:^|[/\\])([A-Za-z0-9_]+)-([A-Za-z0-9_]+)-[a-z]+-[0-9]+-Data\.db"
    hit = path.rlike(pattern)
    keyspace = F.when(hit, F.regexp_extract(path, pattern, 1)).when(path.rlike(old), F.regexp_extract(path, old, 1))
    name = F.when(hit, F.regexp_extract(path, pattern, 2)).when(path.rlike(old), F.regexp_extract(path, old, 2))
    return F.when(keyspace.isNotNull(), F.struct(keyspace.alias("keyspace"), name.alias("table_name")))


def _bag(name: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(name + "{"), F.array_join(F.array_sort(F.array_distinct(items)), ","), F.lit("}")))


def group_key_fields(class_: Column, subclass: Column, nodes: Column, ranges: Column, bags: Mapping[str, Column]) -> Column:
    """The text that events are grouped by: class without level and orphan bits, (subclass), nodes, token ranges and named bags
    of values. Lists are sorted, so the order in which they were collected doesn't matter; empty parts are left out."""
    name = flag_names(class_, EVENT_CLASSES, LEVEL_MASK | ORPHANED)
    head = F.concat(name, F.coalesce(F.concat(F.lit("("), subclass, F.lit(")")), F.lit("")))
    node_list = F.when(F.size(nodes) > 0, F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(nodes)), ", "), F.lit("]")))
    range_list = F.when(F.size(ranges) > 0, F.array_join(F.array_sort(F.array_distinct(ranges)), ","))
    return F.concat_ws(" ", head, node_list, range_list, *[_bag(k, v) for k, v in bags.items()])


def localize_time(local: Column, zone: Column | str) -> Column:
    """A local time in a zone as UTC."""
    return F.to_utc_timestamp(local, zone)


def config_value_normalize(value: Column) -> Column:
    """A configuration value for comparing: trimmed, unquoted, lower case, inner white space as one space."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(value, r"^\s*[\"']|[\"']\s*$", ""), r"\s+", " ")))


def config_property(name: Column) -> Column:
    """A property name for comparing: trimmed, lower case, path separators as dots."""
    return F.lower(F.regexp_replace(F.trim(name), r"[/\\:]+", "."))


def threshold_weight(value: Column, threshold: Column, weight: Column, factor: Column, penalty: Column, kind: Column) -> Column:
    """The weight of a value against a threshold.

    kind 'over': in proportion below the threshold; 'under': in proportion above it; 'raw over' and 'raw under': the
    other way round. Elsewhere factor * weight, plus the penalty in proportion where there is one.
    """
    pct = value / threshold
    part = factor * pct * weight
    full = F.when(penalty == 0, factor * weight).otherwise((pct * penalty + factor) * weight)
    inside = F.when(kind == "over", pct < 1).when(kind == "under", pct > 1).when(kind == "raw over", value > threshold).when(kind == "raw under", value < threshold)
    return F.when(inside, part).when(inside.isNotNull(), full)


def weigh(value: Column, rule: Mapping[str, float] | None) -> Column | None:
    """threshold_weight with a rule (threshold, weight, factor, penalty, kind) from a thresholds file; None for no rule."""
    if rule is None:
        return None
    lit = lambda k, d: F.lit(rule.get(k, d))
    return threshold_weight(value, lit("threshold", 1.0), lit("weight", 1.0), lit("factor", 1.0), lit("penalty", 0.0), lit("kind", "over"))


def attr_weight(rules: Mapping[str, Mapping[str, float] | None], high: Column, low: Column, mean: Column, spread: Column | None = None) -> Column:
    """The weight of an attribute from its max, min, mean and standard deviation.

    If all three are equal the attribute's own rule (or else the mean's) decides. Otherwise the weights add up; the
    maximum is weighed with the attribute's own rule. A missing rule weighs 0.
    """
    zero = F.lit(0.0)
    of = lambda v, k: weigh(v, rules.get(k)) if rules.get(k) is not None else None
    add = lambda *cs: sum((c for c in cs if c is not None), zero)
    one = of(mean, "attr") if rules.get("attr") is not None else of(mean, "avg")
    std = of(spread, "std") if spread is not None else None
    return F.when((high == low) & (low == mean), add(one, std)).otherwise(add(of(high, "attr"), of(low, "min"), of(mean, "avg"), std))


#: Rules of the attributes that are weighed, and the weight from which a table is flagged. Counts of SSTables,
#: partition sizes in MiB, tombstones as a share of cells, and deviations of tables with a common partition key.
THRESHOLDS = {
    "read_latency": {"trigger": 0.65, "attr": dict(threshold=1.5, factor=1.0, penalty=0.6), "max": dict(threshold=1.5, factor=0.25), "min": dict(threshold=0.75, factor=0.25), "avg": dict(threshold=1.0, factor=0.5, penalty=0.1)},
    "write_latency": {"trigger": 0.65, "attr": dict(threshold=1.0, factor=1.0, penalty=0.6), "max": dict(threshold=1.0, factor=0.25), "min": dict(threshold=0.3, factor=0.25), "avg": dict(threshold=0.6, factor=0.5, penalty=0.1)},
    "sstables": {"trigger": 0.6, "attr": dict(threshold=30.0, factor=1.0, penalty=0.6), "max": dict(threshold=30.0, factor=0.3), "min": dict(threshold=30.0, factor=0.4, penalty=0.1), "avg": dict(threshold=30.0, factor=0.3, penalty=0.2)},
    "partition": {"trigger": 0.6, "attr": dict(threshold=100.0, factor=1.0, penalty=0.6), "max": dict(threshold=100.0, factor=0.3), "min": dict(threshold=100.0, factor=0.4, penalty=0.1), "avg": dict(threshold=100.0, factor=0.3, penalty=0.2)},
    "tombstones": {"trigger": 0.6, "attr": dict(threshold=0.6, factor=1.0, penalty=0.6), "max": dict(threshold=0.6, factor=0.3), "min": dict(threshold=0.6, factor=0.4, penalty=0.1), "avg": dict(threshold=0.6, factor=0.3, penalty=0.2)},
    "common_keys": {"trigger": 0.7, "attr": dict(threshold=70_000.0, factor=1.0, penalty=0.75), "max": dict(threshold=150_000.0, factor=0.5, penalty=0.75), "min": dict(threshold=25_000.0, factor=0.25, penalty=0.25), "avg": dict(threshold=70_000.0, factor=0.3, penalty=0.3)},
}
#: Names of these attributes in a thresholds file.
THRESHOLD_NAMES = {"Local read latency": "read_latency", "Local write latency": "write_latency", "SSTable count": "sstables", "Partition large": "partition", "Tombstone/Live Percent": "tombstones", "Common Partition Keys": "common_keys"}


def read_thresholds(text: str) -> dict[str, dict]:
    """THRESHOLDS as a thresholds file (JSON) gives them; attributes without a name of ours keep their own, unknown kinds of
    calculation count as 'over'."""
    import json

    kinds = {"Normal": "over", "Over": "over", "Under": "under", "RawOver": "raw over", "RawUnder": "raw under"}
    rule = lambda v: dict(threshold=float(v["Threshold"]), weight=float(v.get("Weight", 1)), factor=float(v.get("WeightFactor", 1)), penalty=float(v.get("PenaltyFactor", 0)), kind=kinds.get(str(v.get("CalcType")), "over"))
    parts = {"attr": "AttrValue", "max": "MaxValue", "min": "MinValue", "avg": "AvgValue", "std": "StdDevValue"}
    return {THRESHOLD_NAMES.get(a["AttrName"], a["AttrName"]): {"trigger": float(a["MinTrigger"]), **{k: rule(a[p]) for k, p in parts.items() if a.get(p)}} for a in json.loads(text)}


def lcs_parse(text: Column) -> Column:
    """struct(actual, ideal, splits, max_level, first_split) of a level list such as '[1, 12/10, 85]'.

    'a/b' is a level with a tables where b would be ideal: a split level. Levels are numbered from 0; max_level is the
    last with tables, first_split the first split one; both null if there is none.
    """
    items = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: F.split(x, "/"))
    actual = F.transform(items, lambda x: F.element_at(x, 1).try_cast("long"))
    ideal = F.transform(items, lambda x: F.coalesce(F.try_element_at(x, F.lit(2)), F.element_at(x, 1)).try_cast("long"))
    split = F.transform(items, lambda x: F.size(x) > 1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    with_tables = F.filter(F.sequence(F.lit(1), F.size(actual)), lambda k: F.element_at(actual, k) > 0)
    return F.when(
        text.rlike(r"^\s*\[.*[0-9].*\]\s*$"),
        F.struct(total(actual).alias("actual"), total(ideal).alias("ideal"), F.size(F.filter(split, lambda x: x)).alias("splits"), (F.array_max(with_tables) - 1).alias("max_level"), (F.nullif(F.array_position(split, True), F.lit(0)) - 1).cast("int").alias("first_split")),
    )


TOKEN_MIN, TOKEN_MAX = -(1 << 63), (1 << 63) - 1


def token_slots(start: Column, end: Column) -> Column:
    """Tokens in the range (start, end] of a 64-bit ring, as decimal(20,0). Equal ends are the whole ring."""
    s, e = start.cast("decimal(20,0)"), end.cast("decimal(20,0)")
    low, high = F.lit(str(TOKEN_MIN)).cast("decimal(20,0)"), F.lit(str(TOKEN_MAX)).cast("decimal(20,0)")
    slots = F.when((s > 0) & (e < 0), (e - low) + (high - s)).when(s == e, high - low).when(e < s, (e - low) + (high - s)).otherwise(e - s)
    return slots.cast("decimal(20,0)")
