"""Vector code compression: product codes by exact ball k-means over integer components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, hot_limit, join_skewed, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors compared at once with a whole codebook.
ROWS = 4096


class Codebook:
    """The entries of one part position (rows of integers), with what the balls need: distances between entries, nearest first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.square = (self.entries**2).sum(axis=1)
        gap = np.stack([((self.entries - e) ** 2).sum(axis=1) for e in self.entries])
        np.fill_diagonal(gap, -1)  # an entry comes before all others in its own row
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, axis=1)

    def nearest(self, x: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the given entries (positions, ascending; all if None) to each row of x, and the squared distance; ties to the lower index."""
        entries, square = (self.entries, self.square) if which is None else (self.entries[which], self.square[which])
        # products in doubles are exact below 2 ** 53; larger ones are multiplied as integers
        most = 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2
        kind = np.float64 if most < 1 << 53 else np.int64
        turned, at, near = entries.T.astype(kind), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for k in range(0, len(x), ROWS):
            part = x[k : k + ROWS].astype(kind)
            far = square.astype(kind) - 2 * (part @ turned)
            best = far.argmin(axis=1)
            at[k : k + ROWS] = best
            near[k : k + ROWS] = far[np.arange(len(best)), best]
        return (at if which is None else which[at]), near + (x.astype(np.int64) ** 2).sum(axis=1)

    def moved(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """nearest() of all entries, from an earlier code of each row; and how many distances it took.

        A row at distance r from its entry can only be nearer, or as near, to entries at 2 r or less from that entry.
        The ball of an entry reaches to its farthest row, so entries beyond twice that are no neighbours of it. Rows
        nearer than half the way to the nearest neighbour are the stable core and stay. The others fall into rings by
        the number of neighbours within 2 r, and each ring is compared with its neighbours only. All bounds are exact
        integers, so the result is that of comparing with every entry."""
        own = x - self.entries[code]
        near, out, work = (own * own).sum(axis=1), code.copy(), len(x)
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(self.entries) + 1))
        for j in np.flatnonzero(np.diff(edges)).tolist():
            rows = order[edges[j] : edges[j + 1]]
            reach = np.searchsorted(self.gap[j], 4 * near[rows], "right")  # entries within 2 r, itself first
            ring = np.ceil(np.log2(reach)).astype(int)
            for k in np.unique(ring[ring > 0]).tolist():
                some = rows[ring == k]
                which = np.sort(self.order[j, : reach[ring == k].max()])
                out[some], near[some] = self.nearest(x[some], which)
                work += len(some) * len(which)
        return out, near, work


def _rows(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """An array of binaries of equal length as a matrix."""
    first, last = (np.frombuffer(column.buffers()[1], np.int32)[column.offset + k] for k in (0, len(column)))
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[first:last].view(kind).reshape(len(column), width) if last > first else np.zeros((len(column), width), kind)


def _binaries(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _integers(column: pa.Array, width: int, most: int) -> np.ndarray:
    """floor(1024 x) of each component; shorter vectors are padded by zeros, and numbers beyond `most` become `most`."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.clip(np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -most, most).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _assign(books: Broadcast, width: int, most: int, kind: str, first: bool, sums: bool):
    """Codes of vectors, and behind them the sums of the parts that each entry got in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = [Codebook(b) for b in books.value], width // PARTS
        total = [np.zeros((len(b.entries), w + 1), np.int64) for b in model]
        label = None
        for b in batches:
            label = b.schema.field("label").type
            x = _integers(b.column("x"), width, most) if first else _rows(b.column("x"), np.dtype(kind), width).astype(np.int64)
            old = None if first else _rows(b.column("code"), np.dtype(np.uint8), PARTS).astype(np.int64)
            code, error = np.empty((len(x), PARTS), np.int64), np.zeros(len(x), np.int64)
            for p, book in enumerate(model):
                part = x[:, p * w : (p + 1) * w]
                code[:, p], near = book.nearest(part) if first else book.moved(part, old[:, p])[:2]
                error += near
                if sums:
                    got = np.bincount(code[:, p], minlength=len(book.entries))
                    order = np.argsort(code[:, p], kind="stable")
                    used = np.flatnonzero(got)
                    total[p][:, w] += got
                    if w and len(used):
                        total[p][used, :w] += np.add.reduceat(part[order], (np.cumsum(got) - got)[used], axis=0)
            none = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), _binaries(x.astype(kind)), _binaries(code.astype(np.uint8)), pa.array(error), none, none, pa.nulls(len(x), pa.list_(pa.int64()))],
                ["vec_id", "label", "x", "code", "error", "part", "entry", "sums"],
            )
        if sums and label is not None:
            part, entry = (np.concatenate(c) for c in zip(*[(np.full(len(t), p), np.arange(len(t))) for p, t in enumerate(total)], strict=True))
            rows = np.concatenate(total)
            used = rows[:, w] > 0
            n = int(used.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, label), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(part[used].astype(np.int32)), pa.array(entry[used].astype(np.int32)), pa.array(list(rows[used]), pa.list_(pa.int64()))],
                ["vec_id", "label", "x", "code", "error", "part", "entry", "sums"],
            )

    return run


def _updated(books: list[np.ndarray], rows: DataFrame, w: int) -> list[np.ndarray]:
    """The books with each used entry replaced by the rounded-down mean of its parts; only sums per entry reach the driver."""
    got = rows.filter(F.col("part").isNotNull()).select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col").alias("s")).collect()
    sums = [np.zeros((len(b), w + 1), np.int64) for b in books]
    for r in got:
        sums[r["part"]][r["entry"], r["pos"]] = r["s"]
    return [np.where(s[:, w:] > 0, s[:, :w] // np.maximum(s[:, w:], 1), b) for b, s in zip(books, sums, strict=True)]


def finite_vector(vector: Column) -> Column:
    """Whether a vector is there and holds only finite components."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code binary, error), codebooks) of the finite vectors of (vec_id, embedding, label).

    The codebooks are an array of entries for each of the four part positions; a code has the entry of each part as
    one byte, error is the sum of the squared distances of its parts in integers. Each round is one pass over a table
    that holds integers and codes; a task restricts its comparisons by the balls of the round before, and only sums per
    entry go to the driver. Rows with a null, absent or non-finite vector are dropped. The first codebooks are the parts
    of the smallest vec_ids, ties by vector, nulls last; fewer vectors give fewer entries. Vectors shorter than the
    longest count as padded by zeros, as do lengths that four doesn't divide. Integers saturate where squared distances
    would leave a long (beyond 2**28 for 64 components: |x| of 262,144)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").alias("x"))
    rows = rows.filter(finite_vector(F.col("x")))
    size = rows.agg(F.max(F.size("x")).alias("width"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("most")).first()
    width = -(-(size["width"] or 0) // PARTS) * PARTS
    w = width // PARTS
    bound = int((1 << 62) ** 0.5 / (4 * max(1, w) ** 0.5))
    most = min(bound, int(min(float(size["most"] or 0), 1e30) * SCALE) + 1)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = _integers(pa.array([list(r["x"]) for r in start], pa.list_(pa.float64())), width, most)
    books = [x[:, p * w : (p + 1) * w] for p in range(PARTS)]
    schema = StructType([*StructType.fromDDL("vec_id long").fields, StructField("label", rows.schema["label"].dataType), *StructType.fromDDL("x binary, code binary, error long, part int, entry int, sums array<long>").fields])
    if not start:
        return spark.createDataFrame([], schema).select("vec_id", "label", "code", "error"), books
    for k in range(rounds + 1):
        run = _assign(spark.sparkContext.broadcast(books), width, most, kind, k == 0, k < rounds)
        done = materialize((rows if k == 0 else rows.filter(F.col("part").isNull()).select("vec_id", "label", "x", "code")).mapInArrow(run, schema))
        if k:
            discard(rows)
        rows = done
        if k < rounds:
            books = _updated(books, rows, w)
    return rows.select("vec_id", "label", "code", "error"), books


def codebook_digest(books: Sequence[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def decoded(codes: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """codes with the vector that each code stands for as a new column `decoded` array<float>: the middles of the entries' cells."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast([((b + 0.5) / SCALE).astype(np.float32) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _rows(b.column("code"), np.dtype(np.uint8), PARTS)
            found = np.concatenate([book[code[:, p]] for p, book in enumerate(shared.value)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(found), pa.list_(pa.float32()))], [*b.schema.names, "decoded"])

    return codes.mapInArrow(run, StructType([*codes.schema.fields, *StructType.fromDDL("decoded array<float>").fields]))


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the finite vectors: codes in hex, and the error summed over
    the vectors of equal labels (nulls together)."""
    codes, books = compress(vectors)
    named = codes.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = named.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    rows = join_skewed(named, sums, ["_label"], F.col("_rows") > hot_limit(codes.count()))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))


def _sql_round(k: int, last: bool = False) -> str:
    assign = f"""a{k} AS (SELECT vec_id, label, part, any_value(x) AS x, min({{'d': xx - 2 * list_dot_product(x, c) + cc, 'e': entry}}) AS near FROM p JOIN c{k} USING (part) GROUP BY vec_id, label, part)"""
    update = f""",
u{k} AS (SELECT part, near.e AS entry, pos, floor(sum(x[pos]) / count(*))::DOUBLE AS v FROM (SELECT part, near, x, unnest(generate_series(1, len(x))) AS pos FROM a{k}) GROUP BY ALL),
c{k + 1} AS (SELECT part, entry, c, list_dot_product(c, c) AS cc FROM (SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (SELECT part, entry, list(v ORDER BY pos) AS c FROM u{k} GROUP BY ALL) n ON n.part = o.part AND n.entry = o.entry))"""
    return assign + ("" if last else update)


OP13_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT *, list_dot_product(x, x) AS xx FROM (SELECT vec_id, label, part, x[(part * len(x) // 4 + 1) : ((part + 1) * len(x) // 4)] AS x FROM k, (SELECT unnest([0, 1, 2, 3]) AS part))),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c, xx AS cc FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{", ".join(_sql_round(k, k == ROUNDS) for k in range(ROUNDS + 1))},
r AS (SELECT vec_id, label, string_agg(printf('%02x', near.e), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) FROM (SELECT part, entry, unnest(c) AS v, unnest(generate_series(1, len(c))) AS pos FROM c{ROUNDS})) AS codebooks_sha256
FROM r
"""
