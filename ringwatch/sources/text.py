"""Text sources: rolled logs and the outputs of node tools, read as tables of lines."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import normalize_units
from ..schema import INSTANCE_KINDS

#: A node in a path: an address in a directory or file name.
NODE = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"


def strip(text: Column | str) -> Column:
    """Text without white space at its ends, tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def read_lines(spark: SparkSession, paths: str | Sequence[str], node_pattern: str = NODE) -> DataFrame:
    """(path, node_id, size, block, seq, line) of text files, also gzipped. Within a file (block, seq) is the order of lines,
    however Spark splits it."""
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line")
    )
    return rows.withColumn("node_id", F.nullif(F.regexp_extract("path", node_pattern, 1), F.lit("")))


def running_count(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """rows (path, block, seq, ...) with a running count of `flag` in file order: counted inside each block, after the sum
    of the blocks before it, so a file of any size is spread over tasks."""
    rows = rows.withColumn("_f", flag.cast("long"))
    sums = rows.groupBy("path", "block").agg(F.sum("_f").alias("_s"))
    before = sums.select("path", "block", (F.sum("_s").over(W.partitionBy("path").orderBy("block")) - F.col("_s")).alias("_b"))
    inside = F.sum("_f").over(W.partitionBy("path", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return rows.join(before, ["path", "block"]).withColumn(name, F.col("_b") + inside).drop("_f", "_b")


def read_log_lines(spark: SparkSession, paths: str | Sequence[str], node_pattern: str = NODE) -> DataFrame:
    """Lines of rolled logs with line_no from 1 in each file."""
    return running_count(read_lines(spark, paths, node_pattern), F.lit(True), "line_no")


#: Pattern-layout conversions as (regular expression, column).
_LAYOUT = {
    "level": (r"([A-Z]+)", "level"), "p": (r"([A-Z]+)", "level"), "thread": (r"(.*?)", "thread"), "t": (r"(.*?)", "thread"), "F": (r"([\w.$]+)", "src_file"), "file": (r"([\w.$]+)", "src_file"),
    "L": (r"([0-9]+)", "src_line"), "line": (r"([0-9]+)", "src_line"), "date": (r"([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?)", "ts"), "d": (r"([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?)", "ts"),
    "msg": (r"(.*)", "message"), "m": (r"(.*)", "message"), "message": (r"(.*)", "message"), "c": (r"([\w.$]+)", "logger"), "logger": (r"([\w.$]+)", "logger"),
}
DEFAULT_LAYOUT = "%-5level [%thread] %date{ISO8601} %F:%L - %msg%n"


def header_pattern(layout: str = DEFAULT_LAYOUT) -> tuple[str, list[str]]:
    """A pattern layout as one regular expression, and the columns of its groups."""
    out, names, at = "^", [], 0
    for m in re.finditer(r"%(-?[0-9]*)(?:\.[0-9]+)?([A-Za-z]+)(?:\{[^}]*\})?", layout):
        out += re.sub(r"\\? +", r"\\s+", re.escape(layout[at : m.start()]))
        at = m.end()
        if m[2] in ("n",):
            continue
        pattern, name = _LAYOUT[m[2]]
        names.append(name)
        out += (r"\s*" if m[1] and not m[1].startswith("-") else "") + pattern + (r"\s*" if m[1].startswith("-") else "")
    return out + re.sub(r"\\? +", r"\\s+", re.escape(layout[at:])) + "$", names


def assemble_records(lines: DataFrame, layout: str = DEFAULT_LAYOUT) -> DataFrame:
    """Lines (path, block, seq, line_no, line) as records: a line that isn't a header belongs to the record above it, as one of
    `extra`. Lines before the first header of a file are dropped: there is no record they belong to."""
    pattern, _ = header_pattern(layout)
    head = F.col("line").rlike(pattern)
    rows = running_count(lines, head, "record_no").filter("record_no > 0")
    item = F.struct("line_no", "line")
    keep = [c for c in ("node_id", "size") if c in lines.columns]
    rows = rows.groupBy("path", "record_no", *keep).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("path", *keep, F.element_at("items", 1)["line_no"].alias("line_no"), F.element_at("items", 1)["line"].alias("line"), F.transform(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), lambda x: x["line"]).alias("extra"))


def parse_header(records: DataFrame, layout: str = DEFAULT_LAYOUT) -> DataFrame:
    """Records with the columns of their header; times may have a comma before the milliseconds."""
    pattern, names = header_pattern(layout)
    rows = records.withColumns({n: F.regexp_extract("line", pattern, k) for k, n in enumerate(names, 1)}).drop("line")
    if "ts" in names:
        rows = rows.withColumn("ts", F.regexp_replace("ts", ",", ".").try_cast("timestamp"))
    return rows.withColumn("src_line", F.col("src_line").try_cast("int")) if "src_line" in names else rows


def log_file_inventory(events: DataFrame) -> DataFrame:
    """Per log file its range, records, size, kind and restarts. events (path, node_id, size, ts, class_name): a restart runs
    from a shutdown to the next start in the same file."""
    over = W.partitionBy("path").orderBy("ts", "line_no")
    marks = events.filter(F.col("class_name").isin("Shutdown", "NodeStart"))
    down = F.when((F.lag("class_name").over(over) == "Shutdown") & (F.col("class_name") == "NodeStart"), F.struct(F.lag("ts").over(over).alias("min"), F.col("ts").alias("max")))
    restarts = marks.withColumn("r", down).groupBy("path").agg(F.array_sort(F.collect_list("r")).alias("restarts"))
    base = events.groupBy("path", "node_id").agg(F.min("ts").alias("file_min"), F.max("ts").alias("file_max"), F.count(F.lit(1)).alias("items"), (F.max("size") / 1048576).alias("size_mib"))
    rows = base.join(restarts, "path", "left").withColumn("restarts", F.coalesce("restarts", F.array().cast("array<struct<min:timestamp,max:timestamp>>")))
    return rows.withColumn("is_debug", F.col("path").rlike(r"(?i)debug"))


def running_last(rows: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """rows (path, block, seq, ...) with the last value so far of each column of `values` that isn't null, in file order: inside each
    block, or else the last one of the blocks before it, so a file of any size is spread over tasks."""
    rows = rows.withColumns({f"_v{n}": c for n, c in enumerate(values.values())})
    known = lambda n, c: F.when(F.col(f"_v{n}").isNotNull(), F.col(c))
    lasts = rows.groupBy("path", "block").agg(*[F.max_by(known(n, f"_v{n}"), known(n, "seq")).alias(f"_l{n}") for n in range(len(values))])
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = lasts.select("path", "block", *[F.last(f"_l{n}", ignorenulls=True).over(earlier).alias(f"_b{n}") for n in range(len(values))])
    inside = W.partitionBy("path", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"_v{n}": F.last(f"_v{n}", ignorenulls=True).over(inside) for n in range(len(values))}).join(before, ["path", "block"])
    out = rows.withColumns({name: F.coalesce(f"_v{n}", f"_b{n}") for n, name in enumerate(values)})
    return out.drop(*[f"_{k}{n}" for k in "vb" for n in range(len(values))])


def _long(rows: DataFrame, source: str, keys: Sequence[str], attr: Column, value: Column) -> DataFrame:
    """Statistics in long form: numbers with their normalised unit, anything else as text."""
    v = normalize_units(value)
    return rows.select(F.lit(source).alias("source"), *keys, attr.alias("attr"), v["value"].alias("num_value"), F.when(v["value"].isNull(), strip(value)).alias("str_value"), F.when(v["value"].isNotNull(), v["unit"]).alias("uom"))


def read_table_stats(lines: DataFrame) -> DataFrame:
    """Table statistics: 'Keyspace : x' and 'Table: y' sections with 'attribute: value unit' lines, as long statistics."""
    rows = lines.withColumns({"k": F.nullif(F.regexp_extract("line", r"^\s*Keyspace\s*:\s*(\S+)", 1), F.lit("")), "t": F.nullif(F.regexp_extract("line", r"^\s*Table(?: \(index\))?\s*:\s*(\S+)", 1), F.lit(""))})
    mark = F.when(F.col("k").isNotNull(), F.struct(F.lit(None).cast("string").alias("t"))).when(F.col("t").isNotNull(), F.struct("t"))
    rows = running_last(rows, {"keyspace": F.col("k"), "table_name": mark}).withColumn("table_name", F.col("table_name.t"))
    rows = rows.filter("k is null and t is null and keyspace is not null").filter(F.col("line").rlike(r"^\s*[^:]+:\s*\S"))
    return _long(rows, "tablestats", ["node_id", "keyspace", "table_name"], strip(F.substring_index("line", ":", 1)), strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)))


def read_pool_stats(lines: DataFrame) -> DataFrame:
    """Thread-pool statistics in three layouts, told apart by the number of columns: pools with five or more numbers, dropped
    messages with one, dropped messages with latency percentiles."""
    w = F.split(strip("line"), r"\s{2,}|\s+(?=[0-9N-])")
    rows = lines.filter(F.col("line").rlike(r"\S\s+(?:[0-9]|N/A)")).withColumns({"name": F.element_at(w, 1), "v": F.slice(w, F.lit(2), F.size(w))})
    n = F.size("v")
    wide, drop, late = ("Active", "Pending", "Completed", "Blocked", "All time blocked"), ("Dropped",), ("Dropped", "Queue.Latency.Waiting.50%", "Queue.Latency.Waiting.95%", "Queue.Latency.Waiting.99%", "Queue.Latency.Waiting.Max")
    names = lambda prefix, cols: F.array(*[F.concat(F.lit(prefix), F.col("name"), F.lit("." + c)) for c in cols])
    attrs = F.when(n == 1, names("", drop)).when((n == 5) & F.element_at("v", 2).contains("."), names("", late)).when(n >= 5, names("Pool Name.", wide))
    rows = rows.filter(attrs.isNotNull()).select("node_id", F.explode(F.arrays_zip(attrs.alias("attr"), F.col("v").alias("v"))).alias("x")).filter("x.attr is not null")
    return _long(rows, "tpstats", ["node_id"], F.col("x.attr"), F.nullif(F.col("x.v"), F.lit("N/A")))


def read_ring(lines: DataFrame) -> DataFrame:
    """Token ring: 'Datacenter: x' sections of address, rack, status, state, load, owns, token lines."""
    dc = F.nullif(F.regexp_extract("line", r"^\s*Datacenter:\s*(\S+)", 1), F.lit(""))
    p = r"^\s*([0-9a-fA-F.:]+)\s+(\S+)\s+(Up|Down)\s+(\S+)\s+([0-9.,]+ ?\S+)\s+([0-9.]+%|\?)\s+(-?[0-9]+)\s*$"
    rows = running_last(lines, {"dc": dc}).filter(F.col("line").rlike(p))
    g = lambda k: F.regexp_extract("line", p, k)
    return rows.select("dc", g(1).alias("address"), g(2).alias("rack"), g(3).alias("status"), g(4).alias("state"), normalize_units(g(5))["value"].alias("load_mib"), normalize_units(g(6))["value"].alias("owns"), g(7).cast("decimal(20,0)").alias("token"))


def read_workload_ring(lines: DataFrame) -> DataFrame:
    """Node list with workloads: lines of [server id] address, dc, rack, workload, [graph], status, state, load, owns, tokens or
    token, [health].

    kinds are the instance kinds that the workload's name holds, Graph also where the graph column says yes, and
    MultiInstance where there is a server id. The last header of the file says whether the number is a token or a number of
    tokens; role is what the workload names in parentheses. Other lines are skipped."""
    header = F.when(F.col("line").rlike(r"^\s*(?:Address|Server ID)\s"), F.col("line").rlike(r"\sToken\s*$"))
    p = (
        r"^\s*(?:((?:[0-9A-Fa-f]{2}-)+[0-9A-Fa-f]{2})\s+)?([0-9a-zA-Z.:_-]+)\s+(\S+)\s+(\S+)\s+([A-Za-z]+)(?:\((\w+)\))?\s+(?:(yes|no)\s+)?"
        r"(Up|Down|\?)\s+(\S+)\s+([0-9.,]+ ?[A-Za-z]+|\?)\s+([0-9.]+%|\?)\s+(-?[0-9]+)(?:\s+([0-9.]+))?\s*$"
    )
    rows = running_last(lines, {"_by_token": header}).withColumn("_by_token", F.coalesce("_by_token", F.lit(False))).filter(F.col("line").rlike(p))
    g = lambda k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    graph = F.coalesce(g(7) == "yes", F.lit(False))
    kinds = [F.when(F.lower(g(5)).contains(k.lower()) | (graph if k == "Graph" else F.lit(False)), k) for k in INSTANCE_KINDS]
    kinds.append(F.when(g(1).isNotNull(), "MultiInstance"))
    return rows.select(
        g(1).alias("server_id"), g(2).alias("address"), g(3).alias("dc"), g(4).alias("rack"), g(5).alias("workload"), g(6).alias("role"), F.array_compact(F.array(*kinds)).alias("kinds"), g(8).alias("status"), g(9).alias("state"),
        normalize_units(g(10))["value"].alias("load_mib"), normalize_units(g(11))["value"].alias("owns"), F.when(~F.col("_by_token"), g(12).try_cast("int")).alias("tokens"), F.when(F.col("_by_token"), g(12).cast("decimal(20,0)")).alias("token"), g(13).cast("double").alias("health"),
    )


def read_status(lines: DataFrame) -> DataFrame:
    """Node status: 'Datacenter: x' sections of 'UN address load tokens owns host-id rack' lines."""
    dc = F.nullif(F.regexp_extract("line", r"^\s*Datacenter:\s*(\S+)", 1), F.lit(""))
    p = r"^\s*([UD])([NLJM])\s+(\S+)\s+([0-9.,]+ ?\S+|\?)\s+([0-9]+)\s+([0-9.]+%|\?)\s+(\S+)\s+(\S+)\s*$"
    rows = running_last(lines, {"dc": dc}).filter(F.col("line").rlike(p))
    g = lambda k: F.regexp_extract("line", p, k)
    return rows.select("dc", g(3).alias("address"), F.when(g(1) == "U", "Up").otherwise("Down").alias("status"), g(2).alias("state"), normalize_units(g(4))["value"].alias("load_mib"), g(5).try_cast("int").alias("tokens"), normalize_units(g(6))["value"].alias("owns"), g(7).alias("host_id"), g(8).alias("rack"))


def read_facts(lines: DataFrame, source: str = "info") -> DataFrame:
    """'name : value unit' lines (node information, ntp, load average, agent version) as long statistics."""
    p = r"^\s*([^:=]+?)\s*[:=]\s*(\S.*?)\s*$"
    rows = lines.filter(F.col("line").rlike(p))
    return _long(rows, source, ["node_id"], F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2))


read_info = read_facts


def read_clock_facts(lines: DataFrame) -> DataFrame:
    """Facts of clock, load and agent files: stratum, offsets, the three load averages, the version."""
    found = {"stratum": r"stratum\s+([0-9]+)", "time correct to": r"time correct to within\s+([0-9.]+ ms)", "offset": r"offset\s+(-?[0-9.]+)", "load 1 min": r"load average:\s*([0-9.]+)", "load 5 min": r"load average:\s*[0-9.]+,\s*([0-9.]+)", "load 15 min": r"load average:\s*[0-9.]+,\s*[0-9.]+,\s*([0-9.]+)", "version": r"^\s*v?([0-9]+\.[0-9]+\.[0-9]+\S*)\s*$"}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.nullif(F.regexp_extract("line", p, 1), F.lit("")).alias("v")) for k, p in found.items()])
    rows = lines.select("node_id", F.explode(pairs).alias("x")).filter("x.v is not null")
    return _long(rows, "clock", ["node_id"], F.col("x.k"), F.col("x.v"))


def read_histograms(lines: DataFrame) -> DataFrame:
    """Latency histogram: a row per percentile with the columns read, write, range, CAS read, CAS write and view write latency
    in microseconds, as long statistics in ms."""
    names = ("read", "write", "range", "cas_read", "cas_write", "view_write")
    w = F.split(strip("line"), r"\s+")
    rows = lines.filter(F.col("line").rlike(r"^\s*(?:[0-9]+%|Min|Max)\s+[0-9]")).withColumn("w", w)
    pairs = F.transform(F.sequence(F.lit(2), F.least(F.size("w"), F.lit(len(names) + 1))), lambda k: F.struct(F.concat(F.element_at(F.array(*map(F.lit, names)), k - 1), F.lit("."), F.element_at("w", 1)).alias("attr"), (F.element_at("w", k).try_cast("double") / 1000).alias("v")))
    rows = rows.select("node_id", F.explode(pairs).alias("x"))
    return rows.select(F.lit("histogram").alias("source"), "node_id", F.col("x.attr").alias("attr"), F.col("x.v").alias("num_value"), F.lit("ms").alias("uom"))


def read_config_lines(lines: DataFrame, cfg_type: str = "yaml") -> DataFrame:
    """YAML, env and properties files as (property path, value) lines: indentation opens a path, '- ' items are numbered from 0.

    A configuration file is one small document, so each is folded as one array of lines."""
    text = F.regexp_replace("line", r"(^|\s)#.*$", "")
    item = r"^(\s*)((?:- )*)\s*(?:export\s+)?([^:=\s][^:=]*?)?\s*(?:[:=]\s*(.*?))?\s*$"
    rows = lines.withColumn("t", text).filter(F.col("t").rlike(r"\S") & ~F.col("t").rlike(r"^\s*(---|\.\.\.)\s*$"))
    one = F.struct("block", "seq", F.length(F.regexp_extract("t", r"^(\s*)", 1)).alias("indent"), F.col("t").rlike(r"^\s*- ").alias("dash"), strip(F.regexp_extract("t", item, 3)).alias("key"), F.regexp_replace(strip(F.regexp_extract("t", item, 4)), r"^[\"']|[\"']$", "").alias("value"), F.col("t").rlike(r"[:=]").alias("pair"))
    rows = rows.groupBy("path", "node_id").agg(F.array_sort(F.collect_list(one)).alias("items"))
    kind = "struct<stack:array<struct<indent:int,key:string,n:int>>,out:array<struct<property:string,value:string>>>"

    def step(acc: Column, x: Column) -> Column:
        depth = x["indent"] + F.when(x["dash"], 2).otherwise(0)
        above = F.filter(acc["stack"], lambda s: s["indent"] < F.when(x["dash"], x["indent"] + 1).otherwise(x["indent"]))
        siblings = F.filter(acc["stack"], lambda s: (s["indent"] == x["indent"] + 1) & s["key"].rlike(r"^[0-9]+$"))
        nth = F.coalesce(F.try_element_at(siblings, F.lit(-1))["n"] + 1, F.lit(0))
        number = F.struct((x["indent"] + 1).cast("int").alias("indent"), nth.cast("string").alias("key"), nth.cast("int").alias("n"))
        base = F.when(x["dash"], F.concat(F.filter(above, lambda s: s["indent"] <= x["indent"]), F.array(number))).otherwise(above)
        own = F.struct(depth.cast("int").alias("indent"), x["key"].alias("key"), F.lit(0).alias("n"))
        path = F.array_join(F.transform(F.when(x["pair"], F.concat(base, F.array(own))).otherwise(base), lambda s: s["key"]), ".")
        value = F.when(x["pair"], x["value"]).otherwise(x["key"])
        line = F.when(value != "", F.array(F.struct(path.alias("property"), value.alias("value")))).otherwise(F.array())
        return F.struct(F.when(x["pair"], F.concat(base, F.array(own))).otherwise(base).alias("stack"), F.concat(acc["out"], line).alias("out")).cast(kind)

    empty = F.struct(F.array().alias("stack"), F.array().alias("out")).cast(kind)
    out = F.aggregate("items", empty, step, lambda acc: acc["out"])
    return rows.select("node_id", F.lit(cfg_type).alias("cfg_type"), F.col("path").alias("source"), F.explode(out).alias("x")).select("node_id", "cfg_type", "source", "x.property", "x.value")


def read_hosts_map(lines: DataFrame) -> DataFrame:
    """A hosts file as (address, name) rows; comments and blank lines are skipped."""
    w = F.split(strip(F.regexp_replace("line", r"#.*$", "")), r"\s+")
    return lines.filter(F.size(w) > 1).select(F.element_at(w, 1).alias("address"), F.explode(F.slice(w, F.lit(2), F.size(w))).alias("name"))


def read_describe_cluster(lines: DataFrame) -> DataFrame:
    """Cluster description as (attr, value, node) rows: name, snitch, partitioner, and each schema version with its nodes."""
    fact = r"^\s*(Name|Snitch|Partitioner|DynamicEndPointSnitch)\s*:\s*(.+?)\s*$"
    version = r"^\s*([0-9a-fA-F-]{36}|UNREACHABLE)\s*:\s*\[(.*)\]\s*$"
    facts = lines.filter(F.col("line").rlike(fact)).select(F.regexp_extract("line", fact, 1).alias("attr"), F.regexp_extract("line", fact, 2).alias("value"), F.lit(None).cast("string").alias("node"))
    nodes = lines.filter(F.col("line").rlike(version)).select(F.lit("Schema version").alias("attr"), F.regexp_extract("line", version, 1).alias("value"), F.explode(F.split(F.regexp_extract("line", version, 2), r"\s*,\s*")).alias("node"))
    return facts.unionByName(nodes)
