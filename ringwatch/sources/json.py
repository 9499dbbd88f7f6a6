"""JSON sources and the result sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import NODE


def _object(value: Column) -> Column:
    """Whether a variant is an object with a field."""
    text = F.to_json(value)
    return text.startswith("{") & (text != "{}")


def json_facts(documents: DataFrame, source: str = "facts") -> DataFrame:
    """Documents (node_id, v) as long statistics: a row per leaf, however deep, named by its path. Lists are leaves and
    stay JSON text, so does an empty object inside another; null leaves have neither number nor text. A text that is no JSON object, or
    an object that has a key twice, gives no row.

    Documents are parsed to variants, whose fields are taken apart level by level, in one pass for all levels, until no value is an
    object; how many levels there are is looked up on the way, a job each that ends at the first object it finds."""
    spark = documents.sparkSession
    rows = documents.select(F.col("node_id").cast("string"), F.lit(None).cast("string").alias("attr"), F.try_parse_json(F.col("v").cast("string")).alias("leaf")).filter(_object(F.col("leaf")))
    while True:
        rows = rows.withColumn("_whole", F.when(_object(F.col("leaf")), F.col("leaf")))
        rows = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("_whole").outer()))
        taken = F.col("_whole").isNotNull()
        rows = rows.select("node_id", F.when(taken, F.concat_ws(".", "attr", "key")).otherwise(F.col("attr")).alias("attr"), F.when(taken, F.col("value")).otherwise(F.col("leaf")).alias("leaf"))
        if rows.filter(_object(F.col("leaf"))).isEmpty():
            break
    text = F.when(~F.is_variant_null("leaf"), F.variant_get("leaf", "$", "string"))
    number = text.try_cast("double")
    return rows.select(F.lit(source).alias("source"), "node_id", "attr", number.alias("num_value"), F.when(number.isNull(), text).alias("str_value"))


def read_json_facts(spark: SparkSession, paths: str | Sequence[str], source: str = "facts", node_pattern: str = NODE) -> DataFrame:
    """json_facts of per-node files (cpu, memory, disks, heap, index sizes); the node is read from the path."""
    rows = spark.read.text(paths, wholetext=True)
    return json_facts(rows.select(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), node_pattern, 1), F.lit("")).alias("node_id"), F.col("value").alias("v")), source)


def node_info(documents: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Cluster-wide documents (value) keyed by node as a row per node. fields: column name -> JSON path below the node."""
    rows = documents.select(F.explode(F.from_json("value", "map<string,string>")).alias("node_id", "_v"))
    return rows.select("node_id", *[F.get_json_object("_v", p).alias(c) for c, p in fields.items()])


def read_node_info(spark: SparkSession, paths: str | Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """node_info of files."""
    return node_info(spark.read.text(paths, wholetext=True), fields)


SCHEMA_DOCUMENT = (
    "metadata struct<name:string,timestamp:bigint,insightType:string,tags:map<string,string>>, data struct<keyspaces:array<struct<name:string,replication:map<string,string>,"
    "tables:array<struct<name:string,id:string,compaction:string,columns:array<struct<name:string,type:string,kind:string,position:int>>>>,"
    "indexes:array<struct<name:string,table:string>>,views:array<struct<name:string,table:string>>>>>"
)


def read_schema_objects(documents: DataFrame) -> DataFrame:
    """Schema insight documents (SCHEMA_DOCUMENT) as rows (keyspace, name, kind, base_table, id, compaction)."""
    k = documents.select(F.explode("data.keyspaces").alias("k"))
    empty = F.lit(None).cast("string")
    keyspaces = k.select(F.col("k.name").alias("keyspace"), F.col("k.name").alias("name"), F.lit("keyspace").alias("kind"), empty.alias("base_table"), empty.alias("id"), empty.alias("compaction"))
    tables = k.select(F.col("k.name").alias("keyspace"), F.explode("k.tables").alias("t")).select("keyspace", F.col("t.name").alias("name"), F.lit("table").alias("kind"), empty.alias("base_table"), F.col("t.id").alias("id"), F.col("t.compaction").alias("compaction"))
    out = keyspaces.unionByName(tables)
    for many, kind in (("indexes", "index"), ("views", "view")):
        out = out.unionByName(k.select(F.col("k.name").alias("keyspace"), F.explode(f"k.{many}").alias("t")).select("keyspace", F.col("t.name").alias("name"), F.lit(kind).alias("kind"), F.col("t.table").alias("base_table"), empty.alias("id"), empty.alias("compaction")))
    return out


def read_schema_columns(documents: DataFrame) -> DataFrame:
    """Schema insight documents as rows (keyspace, table_name, name, cql_type, kind, position)."""
    t = documents.select(F.explode("data.keyspaces").alias("k")).select(F.col("k.name").alias("keyspace"), F.explode("k.tables").alias("t"))
    return t.select("keyspace", F.col("t.name").alias("table_name"), F.explode("t.columns").alias("c")).select("keyspace", "table_name", F.col("c.name").alias("name"), F.col("c.type").alias("cql_type"), F.col("c.kind").alias("kind"), F.col("c.position").alias("position"))


def read_insights(spark: SparkSession, root: str, schema: str, name: str, day: str | None = None) -> DataFrame:
    """Insight documents of a kind, from folders name=<kind>/day=<yyyy-MM-dd>: the filter prunes folders. Metadata times in
    milliseconds become ts."""
    rows = spark.read.schema(f"{schema}, name string, day date").json(root).filter(F.col("name") == name)
    rows = rows.filter(F.col("day") == F.to_date(F.lit(day))) if day else rows
    return rows.withColumn("ts", F.timestamp_millis("metadata.timestamp"))


#: The order of the rows of result tables, by table.
RESULT_ORDER = {
    "tagged": ("keyspace", "strategy", "table_name", "dc", "node_id"), "log_aggregation": ("bucket", "first_ts", "last_ts"), "common_keys": ("dc", "group_no", "keyspace", "table_name"),
}


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df sorted over all its partitions by those of the columns that it has, nulls first: partitions of a range each, so no task sees
    all rows. Written as files, their names and rows are in the order."""
    by = [c for c in order if c in df.columns]
    return df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df


def write_results(results: Mapping[str, DataFrame], root: str, run_id: str, order: Mapping[str, Sequence[str]] = RESULT_ORDER) -> None:
    """Write each result table under root/<table>/run_id=<run>, its rows in the table's order if it has one; a run that is written again
    replaces its own partition only."""
    for name, df in results.items():
        rows = in_order(df, order.get(name, ()))
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def read_history(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All runs of a result table."""
    return spark.read.parquet(f"{root}/{name}")
