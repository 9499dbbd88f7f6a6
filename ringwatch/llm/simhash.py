"""SimHash near-duplicates: exact comparison of fingerprint tiles with numpy exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Forest, hot_limit, join_skewed, materialize, table, with_least
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Quarters of a fingerprint whose population counts give its tile.
PARTS = 4
#: Fingerprints in a block at most, about: two blocks fit a task at any corpus size. Pairs compared at once.
BLOCK, CELLS = 1 << 19, 1 << 20
#: Blocks of about equal size that random fingerprints fill, by the width of a block in population counts.
BLOCKS = {8: 16, 4: 28, 2: 290}
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 text as a signed 64-bit number; no word: 0."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BITS) > len(h)).astype(np.uint8)
    return int(np.packbits(bits, axis=1, bitorder="little").ravel().view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array((fingerprint(t.as_py()) for t in b.column("text")), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _added(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint((t.as_py() or "").encode()) for t in b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fp], [*b.schema.names, name])

    return run


def add_fingerprints(docs: DataFrame, name: str) -> DataFrame:
    """docs with the fingerprint of each text as a new column."""
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_added(name), StructType([*docs.schema.fields, StructField(name, LongType())]))


def _counts(fp: np.ndarray) -> np.ndarray:
    """The population counts of the four quarters of each fingerprint (rows)."""
    return np.bitwise_count(fp.view("<u2").reshape(-1, PARTS)).astype(np.int16)


class _Tiles:
    """Fingerprints in tiles of equal population counts."""

    def __init__(self, fp: np.ndarray):
        counts = _counts(fp)
        order = np.lexsort(counts.T)
        self.fp, counts = fp[order], counts[order]
        self.first = np.flatnonzero(np.r_[True, (counts[1:] != counts[:-1]).any(axis=1)]) if len(fp) else np.zeros(0, np.int64)
        self.counts, self.size = counts[self.first], np.diff(np.r_[self.first, len(fp)])

    def near(self, counts: np.ndarray, radius: int) -> np.ndarray:
        """Positions of the fingerprints whose tile's counts differ by the radius or less in all."""
        return np.flatnonzero(np.repeat(np.abs(self.counts - counts).sum(axis=1) <= radius, self.size))


def match_blocks(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links between the fingerprints a and b, or inside a when b is None: exclusive-or and bit
    count of each tile with the tiles whose population counts lie within the radius."""
    own = _Tiles(a)
    other = own if b is None else _Tiles(b)
    forest = Forest(len(a) + (0 if b is None else len(b)))
    for first, size, counts in zip(own.first.tolist(), own.size.tolist(), own.counts, strict=True):
        near = other.near(counts, radius)
        near = near[near > first] if b is None else near
        step = max(1, CELLS // max(1, len(near)))
        for at in range(first, first + size if len(near) else first, step):
            i, j = np.nonzero(np.bitwise_count(own.fp[at : min(at + step, first + size), None] ^ other.fp[None, near]) <= radius)
            i, j = i + at, near[j]
            if b is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                forest.add(i, j if b is None else j + len(a))
    nodes = own.fp if b is None else np.concatenate([own.fp, other.fp])
    i, j = forest.edges()
    return nodes[i], nodes[j]


def _near(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        inside = pdf["a"].iat[0] == pdf["b"].iat[0]
        u, v = match_blocks(fp[side == 0], None if inside else fp[side == 1], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def block_width(n: int, block: int = BLOCK) -> int:
    """The width of a block in population counts: the largest that keeps the blocks of n even fingerprints near `block`."""
    return next((w for w, blocks in BLOCKS.items() if n <= block * blocks), 1)


def near_edges(distinct: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect exactly those of the n distinct fingerprints (fp) which links of `radius` bits connect.

    A fingerprint's tile is given by the population counts of its four quarters, its block by these counts divided by a
    width that shrinks as n grows. A task compares two blocks, and only their fingerprints that lie within the radius
    of the other block reach it: some 7 copies of each while blocks are wide, 129 when each tile is a block. A block
    above `block` rows is dealt over several by hash, so no task grows with a hot tile. The block sizes, at most
    17 to the fourth rows, are the only thing broadcast.
    """
    width = block_width(n, block)
    counts = [f"int(bit_count(shiftrightunsigned(fp, {16 * k}) & 65535))" for k in range(PARTS)]
    rows = distinct.select("fp", *[F.expr(c).alias(f"c{k}") for k, c in enumerate(counts)])
    rows = rows.withColumn("own", F.expr(" + ".join(f"(c{k} div {width}) * {32**k}" for k in range(PARTS))).cast("int"))
    sizes = rows.groupBy("own").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("tiles"))
    sizes = F.broadcast(materialize(sizes))
    reach = -(-radius // width)
    rows = rows.withColumns({"far": F.lit(0).cast("long"), "left": F.lit(radius).cast("long")})
    for k in range(PARTS):  # bits to the block d steps off: to its upper edge below, or to its lower edge above
        bits = lambda d: "0L" if not d else f"c{k} - (c{k} div {width} + {d + 1}) * {width} + 1" if d < 0 else f"(c{k} div {width} + {d}) * {width} - c{k}"  # noqa: B023, E731
        steps = ", ".join(f"named_struct('at', c{k} div {width} + {d}, 'bits', {bits(d)})" for d in range(-reach, reach + 1))
        rows = rows.withColumn("x", F.explode(F.expr(f"filter(array({steps}), x -> x.at between 0 and {16 // width} and x.bits <= left)")))
        rows = rows.withColumns({"far": F.col("far") + F.col("x.at") * 32**k, "left": F.col("left") - F.col("x.bits")})
    rows = rows.select("fp", "own", F.col("far").cast("int"))
    rows = rows.join(sizes, "own").withColumn("sub", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("tiles").cast("long"))).drop("tiles")
    rows = rows.join(sizes.select(F.col("own").alias("far"), "tiles"), "far").withColumn("far_sub", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    code = lambda c, s: F.col(c).cast("long") * (1 << 32) + F.col(s)
    rows = rows.select("fp", code("own", "sub").alias("own"), code("far", "far_sub").alias("far"))
    rows = rows.select("fp", F.least("own", "far").alias("a"), F.greatest("own", "far").alias("b"), (F.col("own") > F.col("far")).cast("byte").alias("side"))
    return rows.groupBy("a", "b").applyInPandas(_near(radius), "u long, v long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of fingerprints at RADIUS or fewer differing bits.
    Equal fingerprints are one node, so copies are never expanded into pairs. Null and empty texts have
    fingerprint 0 and link like any other. Rows with a repeated doc_id each get their row; a null doc_id gets
    the group's smallest id, or null when the group has none. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    total = distinct.agg(F.count(F.lit(1)).alias("fps"), F.sum("rows").alias("rows")).first()
    groups = components(near_edges(distinct, total["fps"])).select(F.col("node").alias("fp"), "component")
    named = materialize(distinct.join(groups, "fp", "left").select("fp", "rows", "least", F.coalesce("component", "fp").alias("component")))
    named = materialize(with_least(named, "component", "least", "component_id", total["fps"]).select("fp", "rows", "component_id"))
    return join_skewed(prints, named, ["fp"], F.col("rows") > hot_limit(total["rows"] or 0)).select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
