"""Events: rules, filters, buckets and the aggregation per bucket and key."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import exception_path, exception_path_text, group_key_fields, has_flag, prop_non_negative, prop_number, prop_positive
from ..schema import EVENT_CLASSES, EVENT_TYPES, LEVEL_MASK, ORPHANED
from .stats import with_one_row


#: The statistics of item_stats, in order.
STATS = ("max", "min", "mean", "std", "sum")


def item_stats(value: Column, name: str) -> list[Column]:
    """Max, min, mean, population standard deviation and sum of a column; all null without a value."""
    return [F.max(value).alias(f"{name}_max"), F.min(value).alias(f"{name}_min"), F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_std"), F.sum(value).alias(f"{name}_sum")]


def bucket_start(ts: Column, minutes: int = 30) -> Column:
    """The start of the aggregation period that a time lies in: [start, start + period)."""
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (step * 1_000_000)) * step)


def bucket_events(events: DataFrame, minutes: int = 30) -> DataFrame:
    """events with the start of the one aggregation period each lies in; computed, not joined."""
    return events.withColumn("bucket", bucket_start(F.col("ts"), minutes))


#: What each analytics group computes from the properties of its events: output columns by group name.
def _sum_positive(name: str, key: str) -> Column:
    return F.sum(prop_positive(F.col("props"), key)).alias(name)


def two_stats(a: Column, b: Column, name: str) -> list[Column]:
    """item_stats of the values of two columns taken together."""
    n, m = F.count(a), F.count(b)
    total = F.coalesce(F.sum(a), F.lit(0.0)) + F.coalesce(F.sum(b), F.lit(0.0))
    apart = F.coalesce(F.pow(F.avg(a) - F.avg(b), 2) * n * m / F.nullif(n + m, F.lit(0)), F.lit(0.0))
    spread = (F.coalesce(F.var_pop(a) * n, F.lit(0.0)) + F.coalesce(F.var_pop(b) * m, F.lit(0.0)) + apart) / F.nullif(n + m, F.lit(0))
    some = lambda x: F.when(n + m > 0, x)
    return [F.greatest(F.max(a), F.max(b)).alias(f"{name}_max"), F.least(F.min(a), F.min(b)).alias(f"{name}_min"), (total / F.nullif(n + m, F.lit(0))).alias(f"{name}_mean"), F.sqrt(spread).alias(f"{name}_std"), some(total).alias(f"{name}_sum")]


def analytics_groups() -> dict[str, list[Column]]:
    """Aggregate expressions of each analytics group over events with props and duration_ms.

    Sentinels stay where they count: missing pending gossip tasks, GC occurrences and their durations and merge counts
    are 0, a missing discarded-statement cache, GC pause and size, rate and inconsistent share of a node sync are -1.
    """
    p = F.col("props")
    pos, non = (lambda k: prop_positive(p, k)), (lambda k: prop_non_negative(p, k))
    count = lambda k: F.when(prop_number(p, k, 0.0) >= 0, prop_number(p, k, 0.0))
    space = lambda k: F.greatest(F.max(non(f"{k}_before")), F.max(non(f"{k}_after")))
    found, expired, found_ms, expired_ms = pos("found_rows"), pos("expired_docs"), pos("found_ms"), pos("expired_ms")
    plain = lambda name, value: item_stats(value, name)
    on_heap = F.count(pos("onheap_mib")) > 0
    heap = lambda name, on, off: [F.when(on_heap, x).otherwise(y).alias(f"{name}_{k}") for k, x, y in zip(STATS, item_stats(on, "x"), item_stats(off, "x"), strict=True)]
    return {
        "DurationStats": plain("duration", F.col("duration_ms")),
        "StatusLoggerPoolStats": [_sum_positive(k, k) for k in ("pending", "completed", "blocked", "all_time_blocked")],
        "StatusLoggerMemTblOPSStats": [*plain("ops", pos("memtable_ops")), *plain("size", pos("memtable_mib"))],
        "LargePartitionRowStats": plain("size", non("partition_mib")),
        "TombstoneStats": [F.sum(non("tombstones")).alias("tombstones"), F.sum(non("live_cells")).alias("live_cells")],
        "GCStats": [
            *[space(k).alias(f"{k}_max") for k in ("eden", "old", "survivor")],
            *[F.sum(non(f"{k}_after") - non(f"{k}_before")).alias(f"{k}_change") for k in ("eden", "old", "survivor")],
            *plain("occurrences", count("occurrences")), *two_stats(count("longest_ms"), count("shortest_ms"), "duration"),
        ],
        "GossipPendingStats": plain("pending", prop_number(p, "pending_tasks", 0.0)),
        "BatchStats": [*plain("partitions", pos("partitions")), *plain("size", pos("batch_mib"))],
        "PreparesDiscardedStats": [*plain("discarded", pos("discarded")), *plain("cache", prop_number(p, "cache_mib"))],
        "GCPauseStats": plain("duration", prop_number(p, "pause_ms")),
        "FlushStats": [
            *plain("ops", pos("flush_ops")), *plain("serialized", pos("serialized_mib")), *plain("flushed", pos("flushed_mib")),
            *heap("heap", pos("onheap_mib"), pos("offheap_mib")), *heap("threshold", non("onheap_pct") / 100, non("offheap_pct") / 100),
        ],
        "CompactionStats": [
            *plain("rows", non("row_rate")), *plain("old", non("old_mib")), *plain("new", non("new_mib")), *plain("read", pos("read_rate")), *plain("write", non("write_rate")),
            *plain("merge_change", count("merge_after") - count("merge_before")),
        ],
        "HintHandOffStats": plain("hints", pos("hint_rows")),
        "MaximumMemoryUsageReachedStats": plain("size", non("max_mib")),
        "FreeDeviceStorageStats": plain("size", non("free_mib")),
        "CompactionInsufficientSpaceStats": plain("size", non("required_mib")),
        "DropStats": [*plain("internal", pos("dropped_internal")), *plain("cross_node", pos("dropped_cross_node")), *plain("latency", pos("latency_ms"))],
        "SolrExpiredStats": [*two_stats(found, expired, "count"), *two_stats(found_ms, expired_ms, "duration"), *two_stats(found / (found_ms / 1000), expired / (expired_ms / 1000), "rate")],
        "NodeSyncStats": [
            *plain("size", prop_number(p, "sync_mib")), *plain("rate", prop_number(p, "sync_rate")), *plain("inconsistent", prop_number(p, "inconsistent_pct")),
            *plain("partial", pos("partial_pct")), *plain("failed", pos("failed_pct")), *plain("uncompleted", pos("uncompleted_pct")),
        ],
    }


def eligible(events: DataFrame) -> DataFrame:
    """Events that are aggregated: exceptions, single events, session ends, spans, aggregates, and begins without an end."""
    t = F.col("type")
    whole = [EVENT_TYPES[k] for k in ("Exception", "SingleInstance", "SessionEnd", "TimeSpan", "AggregateData")]
    keep = F.lit(False)
    for bit in whole:
        keep |= has_flag(t, bit)
    return events.filter(keep | (has_flag(t, EVENT_TYPES["SessionBegin"]) & has_flag(F.col("class"), ORPHANED)))


def log_aggregation(events: DataFrame, keys: Sequence[str], minutes: int = 30, group: str = "DurationStats", sessions: str | None = None) -> DataFrame:
    """One row per aggregation period and key: count, first and last time, whether an event was orphaned, and the
    columns of the analytics group. Null keys form a group. One shuffle by key after partial aggregation."""
    extra = [F.array_sort(F.collect_set(sessions)).alias("sessions")] if sessions else []
    rows = bucket_events(events, minutes)
    head = [F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or(has_flag(F.col("class"), ORPHANED)).alias("has_orphan")]
    return rows.groupBy("bucket", *keys).agg(*head, *extra, *analytics_groups()[group])


#: The columns that rows of the same kind of event have in common, besides bucket, data center and node.
GROUP_KEY = ("keyspace", "table_name", "kind", "related", "exception", "exception_at")
#: Properties that tell events of a class apart.
BAGS = {"Tag": "tag", "Tag1": "tag1", "options": "options"}


def with_group_key(events: DataFrame) -> DataFrame:
    """events with the columns of GROUP_KEY: `kind`, the class without bits of level and orphan, `related`, the text of class, subclass, associated nodes, token ranges and tags that
    group_key_fields makes, `exception`, the outermost exception, and `exception_at`, the path of the exceptions in each other.

    A column that the events lack (keyspace, table_name, subclass, assoc_nodes, token_ranges, props, exception_path, exception) is null."""
    kinds = {"keyspace": "string", "table_name": "string", "subclass": "string", "assoc_nodes": "array<string>", "token_ranges": "array<struct<start:string,end:string>>", "exception": "string", "exception_path": "array<string>", "props": "map<string,string>"}
    rows = events.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in events.columns})
    ranges = F.transform("token_ranges", lambda r: F.concat(F.lit("("), r["start"], F.lit(","), r["end"], F.lit("]")))
    bags = {name: F.filter(F.array(F.try_element_at("props", F.lit(p))), lambda v: v.isNotNull()) for name, p in BAGS.items()}
    known = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    related = group_key_fields(F.col("class"), F.col("subclass"), known(F.col("assoc_nodes")), known(ranges), {k: known(v) for k, v in bags.items()})
    path = F.nullif(exception_path_text("exception_path"), F.lit(""))
    own = F.col("class").bitwiseAND(F.lit(~(LEVEL_MASK | ORPHANED)))
    return rows.withColumns({"related": related, "exception_at": path, "exception": F.coalesce("exception", F.try_element_at("exception_path", F.lit(1))), "kind": own}).select(*events.columns, *[c for c in GROUP_KEY if c not in events.columns])


def _more(props: Column, rule: Mapping) -> Column:
    """props with the repeated groups and the key and value pairs that the rule looks for."""
    for name, pattern in (rule.get("repeat") or {}).items():
        every = F.array_join(F.regexp_extract_all("message", F.lit(pattern), F.lit(1)), ",")
        props = _added(props, F.create_map(F.lit(name), F.nullif(every, F.lit(""))))
    if rule.get("pairs"):
        keys, values = (F.regexp_extract_all("message", F.lit(rule["pairs"]), F.lit(k)) for k in (1, 2))
        each = F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.element_at(values, F.array_position(keys, k).cast("int"))))
        props = _added(props, F.map_from_entries(each))
    return props


def _added(props: Column, more: Column) -> Column:
    return F.map_concat(props, F.map_filter(more, lambda k, v: v.isNotNull() & ~F.map_contains_key(props, k)))


def expand_pattern(pattern: str, macros: Mapping[str, str]) -> str:
    """A pattern with macros: '(?$<name>)' becomes a group of that name with the macro's pattern, '$<!name>' the macro's
    pattern alone. Unknown names stay as they are."""
    pattern = re.sub(r"\(\?\$<(\w+)>\)", lambda m: f"(?P<{m[1]}>{macros[m[1]]})" if m[1] in macros else m[0], pattern)
    return re.sub(r"\$<!(\w+)>", lambda m: macros.get(m[1], m[0]), pattern)


def read_rules(spark: SparkSession, paths: str | Sequence[str], macros: Mapping[str, str] | None = None) -> list[dict]:
    """Rules of JSON files (arrays of rule objects, see classify_events) in the order of their `order` value, then tag, with
    macros expanded. type and class are names of bits, joined by '|'. Rules are a plan's configuration, a handful.

    A rule with a linked_tag takes what it doesn't say itself from the rule of that tag, in whichever of the files it stands: so
    a file can select, reorder and change another's rules. A rule with `template` set is there to be linked only. A link to no
    rule, or in a circle, is an error."""
    kind = (
        "order int, tag string, linked_tag string, template boolean, level string, thread string, file string, message string, parse array<string>, repeat map<string,string>, pairs string, type string, class string, subclass string, analytics_group string,"
        " session_key array<string>, key_action string, lookup array<string>, lookup_action string, match_version int"
    )
    rows = spark.read.schema(kind).option("multiLine", True).json(paths).collect()
    given = [{k: v for k, v in row.asDict().items() if v is not None} for row in rows]
    by_tag = {rule["tag"]: rule for rule in reversed(given) if "tag" in rule}

    def linked(rule: dict, seen: tuple[str, ...] = ()) -> dict:
        tag = rule.get("linked_tag")
        if tag is None:
            return rule
        if tag in seen or tag not in by_tag:
            raise ValueError(f"rule {rule.get('tag')!r} is linked to {tag!r}: " + ("a circle of links" if tag in seen else "no such rule"))
        return {k: v for k, v in linked(by_tag[tag], (*seen, tag)).items() if k not in ("template", "linked_tag")} | rule

    fill, bits = lambda p: expand_pattern(p, macros or {}), {"type": EVENT_TYPES, "class": EVENT_CLASSES}
    out = []
    for rule in map(linked, given):
        if rule.get("template"):
            continue
        rule = {k: v for k, v in rule.items() if k not in ("template", "linked_tag")}
        for key in ("level", "thread", "file", "message", "pairs"):
            if key in rule:
                rule[key] = fill(rule[key])
        if "parse" in rule:
            rule["parse"] = [fill(p) for p in rule["parse"]]
        if "repeat" in rule:
            rule["repeat"] = {k: fill(p) for k, p in rule["repeat"].items()}
        for key, known in bits.items():
            if key in rule:
                rule[key] = sum({known[name.strip()] for name in rule[key].split("|")})
        out.append(rule)
    return sorted(out, key=lambda r: ("order" not in r, r.get("order", 0), r.get("tag") or ""))


_IN_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def mandatory_words(pattern: str) -> frozenset[str] | None:
    """Words of which every text that the pattern matches has at least one, between other characters than letters, digits and
    underscores; None where there is no such set. Of several sets the one whose shortest word is longest."""
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return None
    return None if tree.state.flags & re.IGNORECASE else _words_of_tree(list(tree), False)


def _words_of_tree(items: list, edge: bool) -> frozenset[str] | None:
    """Words of a sequence: literals in a row are text; what may be absent or vary cuts it. edge tells whether no word's
    character can stand before the sequence."""
    found: list[frozenset[str]] = []
    run, start = "", edge

    def cut(known: bool = False) -> None:
        nonlocal run, start
        for m in re.finditer(r"\w\w+", run, re.ASCII):
            if (m.start() > 0 or start) and m.end() < len(run):
                found.append(frozenset((m[0],)))
        run, start = "", known

    for op, value in items:
        name, before = str(op), start if not run else run[-1] not in _IN_WORD
        if name == "LITERAL":
            run += chr(value)
        elif name == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in value[3]):
            run += "".join(chr(v) for _, v in value[3])
        elif name == "AT" and str(value) in ("AT_BEGINNING", "AT_BEGINNING_STRING"):
            cut(True)
        else:
            inner = [value[3]] if name == "SUBPATTERN" else value[1] if name == "BRANCH" else [value[2]] if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0 else []
            words = [_words_of_tree(list(i), before) for i in inner]
            cut()
            if words and all(words):
                found.append(frozenset().union(*words))
    cut()
    return max(found, key=lambda w: (min(map(len, w)), -len(w)), default=None)


def words_pattern(words: Iterable[str]) -> str:
    """A pattern that matches any of the words as a whole word; words with the same beginning share it, so its cost at a place
    of a text depends on how many letters the place shares with a word, not on the number of words."""

    def branch(some: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in some:
            heads.setdefault(w[:1], []).append(w[1:])
        parts = [re.escape(h) + branch(rest) for h, rest in heads.items() if h]
        whole = parts[0] if len(parts) == 1 and "" not in heads else f"(?:{'|'.join(parts)})" if parts else ""
        return f"{whole}?" if "" in heads and parts and len(parts) > 1 else f"(?:{whole})?" if "" in heads and parts else whole

    return rf"(?<![A-Za-z0-9_]){branch(sorted(set(words)))}(?![A-Za-z0-9_])"


def _rule_words(rule: Mapping) -> frozenset[str] | None:
    """Words of which a line that the rule holds for has at least one; None if there are none to name."""
    if rule.get("message") and (words := mandatory_words(rule["message"])):
        return words
    parsed = [mandatory_words(p) for p in rule.get("parse") or []]
    return frozenset().union(*parsed) if parsed and all(parsed) else None


def classify_events(lines: DataFrame, rules: Sequence[Mapping], indexed: bool = True) -> DataFrame:
    """Give each log line (level, thread, src_file, message, ...) its first matching rule.

    A rule has a tag, optional level, thread, file and message patterns, all of which must match, and parse patterns
    with named groups, one of which must match; the named groups of the first that does become `props`. `repeat` (property:
    pattern with one group) adds all its matches, joined by commas; `pairs`, a pattern with two groups, adds a property for
    each key and value that it finds, the first of equal keys; neither replaces a property that is there. session_key is an
    SQL expression, or several of which the first that isn't null counts, and so is lookup. Rules come in the order in which
    they win. New columns: rule (position, null without a match), tag, type, class, subclass, analytics_group, session_key,
    props; if a rule has them also key_action, lookup and lookup_action (see tie_sessions).

    With `indexed` a line tries candidates only: the words that some match of a rule must hold are looked for in one pass
    over the message, and a rule is tried where one of its words is there. Rules without such words are always tried. The hits
    are the same."""
    kinds = {"tag": "string", "type": "long", "class": "long", "subclass": "string", "analytics_group": "string"}
    kinds |= {k: "string" for k in ("key_action", "lookup_action") if any(r.get(k) for r in rules)}
    none, hit_type = F.create_map().cast("map<string,string>"), "struct<rule:int,props:map<string,string>>"
    tests: list[Column] = []
    for k, rule in enumerate(rules):
        hit = F.lit(True)
        for column, key in (("level", "level"), ("thread", "thread"), ("src_file", "file"), ("message", "message")):
            if rule.get(key):
                hit &= F.coalesce(F.col(column).rlike(rule[key]), F.lit(False))
        own, parsed = lambda props, k=k: F.struct(F.lit(k).alias("rule"), props.alias("props")), None
        for pattern in rule.get("parse") or []:
            names = list(re.compile(pattern).groupindex.items())
            java = re.sub(r"\(\?P<\w+>", "(", pattern)
            pairs = [x for name, at in names for x in (F.lit(name), F.nullif(F.regexp_extract("message", java, at), F.lit("")))]
            props = own(_more(F.create_map(*pairs) if pairs else none, rule))
            parsed = F.when(F.col("message").rlike(java), props) if parsed is None else parsed.when(F.col("message").rlike(java), props)
        tests.append(F.when(hit, own(_more(none, rule)) if parsed is None else parsed))
    rows = lines
    if indexed and rules:
        at: dict[str, list[int]] = {}
        always = []
        for k, rule in enumerate(rules):
            for w in sorted(_rule_words(rule) or ()):
                at.setdefault(w, []).append(k)
            if not _rule_words(rule):
                always.append(k)
        tried = F.array(*map(F.lit, always)).cast("array<int>")
        if at:
            found = F.regexp_extract_all("message", F.lit(words_pattern(at)), F.lit(0))
            numbers = F.create_map(*[x for w, ks in at.items() for x in (F.lit(w), F.array(*map(F.lit, ks)))])
            tried = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda w: F.element_at(numbers, w))), tried)))
        # one case a candidate; in a lambda, since the code of many rules in one generated method would be too long to be compiled
        pick_test = lambda k: reduce(lambda c, n: c.when(k == n, tests[n]), range(1, len(tests)), F.when(k == 0, tests[0]))
        hits = F.filter(F.transform(tried, pick_test), lambda h: h.isNotNull())
        rows = rows.withColumn("_hit", F.try_element_at(hits, F.lit(1)))
    else:
        rows = rows.withColumn("_hit", F.coalesce(*tests, F.lit(None).cast(hit_type)))
    rule, defaults = F.col("_hit.rule"), {"type": EVENT_TYPES["SingleInstance"], "class": 0}
    pick = {c: F.try_element_at(F.array(*[F.lit(r.get(c, defaults.get(c))).cast(kind) for r in rules]), rule + 1) if rules else F.lit(None).cast(kind) for c, kind in kinds.items()}
    keyed = {}
    for name in ("session_key", *(["lookup"] if any(r.get("lookup") for r in rules) else [])):
        value = F.lit(None).cast("string")
        for k, r in enumerate(rules):
            if r.get(name):
                keys = [r[name]] if isinstance(r[name], str) else r[name]
                value = F.when(rule == k, F.coalesce(*[F.expr(e).cast("string") for e in keys])).otherwise(value)
        keyed[name] = F.when(F.col("rule").isNotNull(), value)
    rows = rows.withColumns({"rule": rule, **pick, "props": F.col("_hit.props")}).withColumns(keyed)
    return rows.drop("_hit")


def select_rules_for_version(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """The rules that hold for each node version: those without a version, and of each event class the one with the
    highest version not above the node's. rules (tag, class, match_version int), versions (version int): a handful."""
    every = versions.agg(F.sort_array(F.collect_set("version")).alias("every"))
    rows = with_one_row(rules, every)
    fits = F.when(F.col("match_version").isNull(), F.col("every")).otherwise(F.filter("every", lambda v: v >= F.col("match_version")))
    rows = rows.withColumn("version", F.explode(fits)).drop("every")
    free, tied = rows.filter("match_version is null"), rows.filter("match_version is not null")
    best = W.partitionBy("version", "class").orderBy(F.desc("match_version"), "tag")
    tied = tied.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
    return free.unionByName(tied)


def filter_keyspaces(stats: DataFrame, ignore: Sequence[str], warn: Sequence[str], attr: str = "Read Count") -> DataFrame:
    """Drop ignored keyspaces; keep those to warn of only where some table of theirs has a positive `attr`, and mark them."""
    used = stats.filter((F.col("attr") == attr) & (F.col("num_value") > 0)).select(F.col("keyspace").alias("used")).distinct()
    rows = stats.filter(~F.col("keyspace").isin(*ignore)) if ignore else stats
    rows = rows.join(used, F.col("keyspace") == F.col("used"), "left")
    watched = F.col("keyspace").isin(*warn) if warn else F.lit(False)
    return rows.filter(~watched | F.col("used").isNotNull()).withColumn("keyspace", F.when(watched, F.concat("keyspace", F.lit(" (warn)"))).otherwise(F.col("keyspace"))).drop("used")


def ignore_tags(events: DataFrame, tags: DataFrame) -> DataFrame:
    """Events whose tag isn't listed in tags (tag)."""
    return events.join(tags.select("tag").distinct(), "tag", "left_anti")


def cap_events(events: DataFrame, most: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first `most` events of each key: a sampling limit that the caller asks for."""
    return events.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def event_time_range(events: DataFrame, start: str | None = None, end: str | None = None, hours_before: tuple[str, int] | None = None) -> DataFrame:
    """Events in [start, end], or in the hours before a capture time; comparisons reach the scan."""
    if hours_before:
        at, hours = hours_before
        capture = F.to_timestamp(F.lit(at))
        return events.filter((F.col("ts") >= capture - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= capture))
    if start:
        events = events.filter(F.col("ts") >= F.to_timestamp(F.lit(start)))
    return events.filter(F.col("ts") <= F.to_timestamp(F.lit(end))) if end else events


def unhandled_events(lines: DataFrame, levels: Sequence[str] = ("WARN", "ERROR", "FATAL")) -> DataFrame:
    """Lines of these levels that no rule matched, as NotHandled single events. Lines with `extra` (the lines below the header)
    also get the path of the exceptions named there as `exception`, null where there is none."""
    rows = lines.filter(F.col("rule").isNull() & F.col("level").isin(*levels)).withColumns({"type": F.lit(EVENT_TYPES["SingleInstance"]).cast("long"), "class": F.lit(EVENT_CLASSES["NotHandled"]).cast("long")})
    if "extra" not in lines.columns:
        return rows
    path = exception_path(F.array_join(F.concat(F.array(F.coalesce("message", F.lit(""))), F.coalesce("extra", F.array().cast("array<string>"))), "\n"))
    return rows.withColumn("exception", F.nullif(exception_path_text(path), F.lit("")))


def drop_duplicate_lines(lines: DataFrame) -> DataFrame:
    """One of each set of lines of a node with the same source, time and message."""
    return lines.dropDuplicates(["node_id", "src_file", "src_line", "ts", "message"])
