"""Mixing sources to target weights with a time-varying curriculum."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, hot_limit, join_skewed, materialize, table

#: A schedule is a list of (time, weight) knots from time 0 to time 1, linear in between.
Schedule = Sequence[tuple[float, float]]
#: Documents in a bucket, about: a source has as many as it needs, so a hot source's buckets are no larger than another's.
#: The cumulative sum runs over buckets first, then inside each.
BUCKET = 4_000
#: Sources up to so many (some 300 bytes each) are broadcast to the documents.
BROADCAST_SOURCES = 50_000
#: Counts of files are broadcast up to this size; what Spark builds of one, at most.
BROADCAST_BYTES, FILE_BYTES = 64 << 20, 1024


def total_weight(schedule: Schedule) -> float:
    """The integral of the schedule over training time."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def _segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(share of the demand reached, start, weight at start, slope) of each piece of the schedule."""
    whole, reached, out = total_weight(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 > t0 and w0 + w1 > 0:
            out.append((reached, t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
            reached += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def _position(y: Column, segments: Column) -> Column:
    """The time at which the share y of a source's demand is reached: inverts the piecewise quadratic."""
    s = F.try_element_at(F.filter(segments, lambda x: (x["reached"] <= y) | (x["reached"] == 0)), F.lit(-1))
    rest = F.greatest(y - s["reached"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["weight"] * s["weight"] + 2 * s["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), s["start"] + F.when(rest > 0, 2 * rest / (s["weight"] + root)).otherwise(F.lit(0.0)))


def _scheduled(schedule_of: Callable[[int, str | None], Schedule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("reached", "start", "weight", "slope")]))
        for b in batches:
            found = [schedule_of(k, name) for k, name in zip(b.column("rank").to_pylist(), b.column("source").to_pylist(), strict=True)]
            pieces = [[dict(zip(("reached", "start", "weight", "slope"), p, strict=True)) for p in _segments(s)] for s in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(total_weight, found), pa.float64()), pa.array(pieces, kind)], [*b.schema.names, "weight", "segments"])

    return run


SEGMENTS = "segments array<struct<reached double, start double, weight double, slope double>>"


def plan_sources(sums: DataFrame, schedule_of: Callable[[int, str | None], Schedule], budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sources (source, size, n) with rank (by code point from 0, null last), schedule segments, weight and target.

    `budget` times all sizes are shared by weight; no target exceeds `most` times its source's size, and the excess is
    reshared by weight until none does. However many sources there are, only sums over them reach the driver: ranks
    are counted inside range partitions, and each round of resharing is an aggregate."""
    order = F.col("source").asc_nulls_last()
    rows = materialize(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    parts = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    parts = F.broadcast(parts.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("before")))  # a row per range partition
    rows = rows.withColumn("part", F.shiftright("at", 33)).join(parts, "part")
    rows = rows.select("source", "size", "n", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("rank"))
    rows = materialize(rows.mapInArrow(_scheduled(schedule_of), f"source string, size long, n long, rank int, weight double, {SEGMENTS}"))
    cap, level, seen = most * F.col("size"), 0.0, None
    while True:
        full = (F.col("weight") > 0) & (cap < F.col("weight") * level)
        r = rows.agg(F.sum("size").alias("size"), F.count_if(full).alias("full"), F.sum(F.when(full, cap)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["full"] == seen:
            return rows.withColumn("target", F.when(full, cap).otherwise(F.col("weight") * level))
        seen = r["full"]
        left = budget * (r["size"] or 0) - (r["taken"] or 0.0)
        level = left / r["open"] if r["open"] else level


def _with_sources(rows: DataFrame, sources: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """rows joined with the n sources: by broadcast up to BROADCAST_SOURCES, else the hot ones only (at most a thousand) are."""
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources.drop("n")), key)
    return join_skewed(rows, sources, [key], F.col("n") > hot_limit(total)).drop("n")


def plan_mix(docs: DataFrame, schedule_of: Callable[[int, str | None], Schedule], budget: float = 1.5, most: float = 2.0, bucket: int = BUCKET, columns: Sequence[str] | None = None) -> DataFrame:
    """Add to every row of docs (doc_id, text, source, ...) what the mix takes of it and when.

    Sources come in code point order, null last; `schedule_of(rank, source)` gives the weight schedule, whose
    integral is the source's weight. The mix has `budget` times all words. New columns in one struct `mix`:
    size (words), source_size, target, taken (words, repeats counted), copies (array of position, words). A
    source's documents are taken whole, in the order of the MD5 of their doc_id (of their text where that is null), over and
    over; the one at which its target is reached is taken if its middle lies before the target, so the taken words differ from
    the target by half of that document at most. Null texts have size 0 and are not taken. Repeated rows are mixed one by
    one; rows that tie in every key are interchangeable. Neither sources nor documents go through the driver. With
    `columns` only these are kept, so that a plan alone shuffles no text.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sums = materialize(docs.select(F.col("source").cast("string"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    found = plan_sources(sums, schedule_of, budget, most)
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    sources = found.select(named(F.col("source")).alias("name"), "rank", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket)).cast("int").alias("buckets"), F.col("size").alias("source_size"), "target", "segments", "n")
    total = sums.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("rows")).first()
    count = total["sources"], total["rows"] or 0
    h = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.md5(F.col("text").cast("binary")), F.lit(""))
    rows = docs.select(F.struct(*(columns or docs.columns)).alias("row"), F.col("doc_id").alias("id"), named(F.col("source")).alias("name"), size.alias("size"), h.alias("h"))
    rows = _with_sources(rows, sources.select("name", "rank", "buckets", "n"), "name", *count).drop("name")
    part = F.floor(F.coalesce(F.conv(F.substring("h", 1, 8), 16, 10).cast("double"), F.lit(0.0)) / float(1 << 32) * F.col("buckets")).cast("int")
    rows = rows.withColumn("part", part).drop("buckets")
    before = rows.groupBy("rank", "part").agg(F.sum("size").alias("s"))
    before = before.select("rank", "part", (F.sum("s").over(W.partitionBy("rank").orderBy("part")) - F.col("s")).alias("before"))
    order = W.partitionBy("rank", "part").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(before, ["rank", "part"]).withColumn("from", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = _with_sources(rows, sources.drop("name", "buckets"), "rank", *count)
    rounds = F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))

    def copy(k: Column) -> Column:
        middle = k.cast("long") * F.col("source_size") + F.col("from") + F.col("size") / 2
        words = F.when(middle < F.col("target"), F.col("size")).otherwise(F.lit(0)).cast("long")
        return F.struct(_position(middle / F.nullif(F.col("target"), F.lit(0.0)), F.col("segments")).alias("position"), words.alias("words"))

    rows = rows.withColumn("copies", F.filter(F.transform(rounds, copy), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return rows.select("row.*", F.struct("size", "source_size", "target", taken.alias("taken"), "copies").alias("mix"))


def mix_sources(docs: DataFrame, schedule_of: Callable[[int, str | None], Schedule], budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """The training sequence: a row per taken copy with the columns of docs, range-sorted by training position.

    Texts are whole. Documents of which nothing is taken have no row. Written as files, the sequence is that of
    `training_order`."""
    columns = docs.columns
    rows = plan_mix(docs, schedule_of, budget, most).withColumn("copy", F.explode("mix.copies"))
    rows = rows.repartitionByRange(F.col("copy.position"), F.col("doc_id")).sortWithinPartitions("copy.position", "doc_id")
    return rows.select(*columns)


def training_order(docs: DataFrame, name: str = "position") -> DataFrame:
    """docs with their place, from 1, in the sequence that mix_sources wrote as files, in whatever order Spark reads the files: a
    row's number in its file behind the rows of the files before it. Null where docs aren't read from files."""
    files = len(docs.inputFiles())
    if not files:
        return docs.withColumn(name, F.lit(None).cast("long"))
    rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
    order = W.orderBy(F.length("_path"), "_path")  # a row per file
    before = sizes.select("_path", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    before = F.broadcast(before) if FILE_BYTES * files <= BROADCAST_BYTES else before
    return rows.join(before, "_path").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_path", "_row", "_before")


#: The production mix: weights 3, 1, 2 repeating over the sources in code point order.
WEIGHTS = (3, 1, 2)


def production_schedule(rank: int, _: str | None) -> Schedule:
    """Heavy sources fade from half above their weight to half below, light ones stay, the others grow."""
    weight = WEIGHTS[rank % 3]
    first, last = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))[rank % 3]
    return [(0.0, first * weight), (1.0, last * weight)]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan as rows in training order: by the position of a document's first copy, those not taken last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    first = F.round(F.try_element_at("mix.copies", F.lit(1))["position"], 9)
    rows = plan_mix(docs, production_schedule, columns=["doc_id"]).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", first.alias("first_position"), F.size("mix.copies").alias("n_copies"))
    order = F.col("first_position").asc_nulls_last(), F.col("doc_id")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, row_number() OVER (ORDER BY cap / weight, k) AS nth FROM w),
f AS (SELECT min(nth) AS nth FROM o WHERE weight * (rest / open_weight) <= cap),
g AS (SELECT o.rest / o.open_weight AS per, o.nth FROM o JOIN f USING (nth)),
t AS (SELECT o.source, source_size, k, CASE WHEN o.nth >= g.nth THEN weight * g.per ELSE cap END AS target FROM o CROSS JOIN g),
c AS (SELECT d.doc_id, size, source_size, target, k,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY coalesce(md5(d.doc_id::VARCHAR), md5(text), ''), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c0
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN c0 + size / 2.0::DOUBLE < target THEN size ELSE 0 END AS w0, CASE WHEN source_size + c0 + size / 2.0::DOUBLE < target THEN size ELSE 0 END AS w1, CASE k % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, CASE k % 3 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM c),
q AS (SELECT *, CASE WHEN w0 > 0 THEN (c0 + size / 2.0::DOUBLE) / target END AS y FROM p)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
  CASE WHEN w0 > 0 THEN round(least(1.0::DOUBLE, 2 * y / (a + sqrt(greatest(0.0::DOUBLE, a * a + 2 * b * y)))), 9) END AS first_position, ((w0 > 0)::INTEGER + (w1 > 0)::INTEGER)::INTEGER AS n_copies FROM q
"""
