"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, hot_limit, join_skewed, materialize, table, with_least
from .components import components

THRESHOLD = 0.95
#: Chance that a pair at exactly the threshold is verified.
RECALL = 0.995
#: Projections that every vector is counted on, their quantum, and the half width of the query-centred window in quanta
#: (a unit vector's projection is normal with variance 1; beyond EDGE quanta all places are one).
LINES, STEP, WINDOW, EDGE = 32, 0.05, 9, 60
#: Vectors of a sorted run, about, and the size from which a run is dealt over several tasks.
RUN, CROWD = 500, 20_000
SEED = 20_240_607


def window_chance(cosine: float) -> float:
    """The chance that a pair with this cosine collides in the window of one projection."""
    return math.erf(WINDOW * STEP / math.sqrt(2 - 2 * cosine) / math.sqrt(2))


def calibrate(n: int, cosine: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits, tables, count) for n vectors.

    A table sorts the vectors by one projection inside runs of equal signs of `bits` others; as many bits as keep a
    run of unrelated vectors near RUN. `count` is the largest number of window collisions, and `tables` the fewest
    tables, with which a pair at the threshold is verified with the chance `recall`: half of the misses may come from
    each."""
    bits, window, miss = max(2, round(math.log2(max(n, 2) / RUN))), window_chance(cosine), (1 - recall) / 2
    fails = lambda c: sum(math.comb(LINES - 1, k) * window**k * (1 - window) ** (LINES - 1 - k) for k in range(c - 1))
    count = max(c for c in range(1, LINES + 1) if fails(c) <= miss)
    return bits, math.ceil(math.log(miss) / math.log(1 - window * (1 - math.acos(cosine) / math.pi) ** bits)), count


def directions(dim: int, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions for the signs (dim x tables*bits) and for the sorted projections (dim x LINES)."""
    r = np.random.default_rng([SEED, dim, bits, tables])
    return r.standard_normal((dim, tables * bits)), r.standard_normal((dim, LINES))


def sign(u: np.ndarray, bits: int, tables: int, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each unit vector (rows) in each table, and its place on each projection in quanta."""
    signs, lines = known
    side = (u @ signs >= 0).reshape(len(u), tables, bits)
    keys = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) + (u.shape[1] << bits)
    return keys, np.clip(np.floor(u @ lines / STEP), -EDGE, EDGE).astype(np.int8)


def marks_of(keys: np.ndarray) -> np.ndarray:
    """Sixteen bits of a hash of each key: enough to tell whether a pair has met in an earlier table."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Each row is first scaled by a power of two, which is exact, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signatures(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                vectors = [np.array(v, float) for v in b.column("vec").to_pylist()]
                keys, places = np.zeros((len(vectors), tables), np.int64), np.zeros((len(vectors), LINES), np.int8)
                for dim in {len(v) for v in vectors}:
                    rows = [k for k, v in enumerate(vectors) if len(v) == dim]
                    u = unit_rows(np.array([vectors[k] for k in rows]))
                    keys[rows], places[rows] = sign(u, bits, tables, known.setdefault(dim, directions(dim, bits, tables)))
                binary = lambda x: pa.array([row.tobytes() for row in x], pa.binary())
                columns = [b.column("node"), b.column("n"), b.column("vec"), pa.array(list(keys), pa.list_(pa.int64())), binary(places), binary(marks_of(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "vec", "keys", "places", "marks"])

    return run


class _Links:
    """What a task found: for each vector the vectors linked with it, and spanning edges of the links."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, node: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        links = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
        some = np.flatnonzero(links)
        forest = Forest(len(node))
        forest.add(i, j)
        a, b = forest.edges()
        zero = lambda k: np.zeros(len(k), np.int64)
        self.rows.append((node[some], zero(some) - 1, links[some].astype(np.int64)))
        self.rows.append((node[a], node[b], zero(a)))

    def batch(self) -> pa.RecordBatch:
        u, v, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*self.rows, strict=True) if self.rows else ((), (), ())))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (u, v, n)], ["u", "v", "links"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    """The rows of each run (nth, key, a, b) of two rows or more, from batches in that order; None after each batch."""
    waiting: list[pa.Table] = []
    names = ("nth", "key", "a", "b")
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        ids = np.stack([rows.column(k).to_numpy() for k in names])
        cut = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
        for s, e in zip(cut, cut[1:]):
            part = rows.slice(s, e - s)
            if waiting and any(waiting[0].column(k)[0] != part.column(k)[0] for k in names):
                if sum(w.num_rows for w in waiting) > 1:
                    yield pa.concat_tables(waiting)
                waiting = []
            waiting.append(part)
        yield None
    if sum(w.num_rows for w in waiting) > 1:
        yield pa.concat_tables(waiting)


def _bytes(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(rows.num_rows, -1)


def _lists(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.asarray(rows.column(name).combine_chunks().flatten(), kind).reshape(rows.num_rows, -1)


def _side(rows: pa.Table) -> np.ndarray | None:
    """Which block each row of a run is from, None for a run in one piece; with sides, only pairs across them count."""
    return rows.column("side").to_numpy() if rows.column("a")[0] != rows.column("b")[0] else None


def collide(nth: int, rows: np.ndarray, cols: np.ndarray, places: np.ndarray, marks: np.ndarray, pair: np.ndarray, count: int) -> np.ndarray:
    """Which of the pairs (rows x cols) that share a run of table `nth` and its window collide in `count` windows and in
    no earlier table."""
    near = lambda t: np.abs(places[rows, t][:, None] - places[None, cols, t]) <= WINDOW
    hits = np.zeros(pair.shape, np.uint8)
    for t in range(LINES):
        hits += near(t)
    pair = pair & (hits >= count)
    if pair.mean() > 0.02:
        for t in range(nth):
            pair &= ~((marks[rows, t][:, None] == marks[None, cols, t]) & near(t % LINES))
        return pair
    i, j = np.nonzero(pair)
    a, b = rows[i], cols[j]
    for t in range(nth):
        met = (marks[a, t] == marks[b, t]) & (np.abs(places[a, t % LINES] - places[b, t % LINES]) <= WINDOW)
        if met.any():
            pair[i[met], j[met]] = False
    return pair


def flag_run(nth: int, places: np.ndarray, marks: np.ndarray, side: np.ndarray | None, count: int) -> np.ndarray:
    """Which vectors of a run have a partner that passes the collision count here and in no earlier table. A vector is
    compared with the window around it until it has one, so a group of copies costs little."""
    place = places[:, nth % LINES]
    order = np.argsort(place, kind="stable")
    places, marks, place = places[order], marks[order], place[order].astype(np.int16)
    side = None if side is None else side[order]
    first, last = np.searchsorted(place, place - WINDOW), np.searchsorted(place, place + WINDOW, side="right")
    found = np.zeros(len(place), bool)
    for s in range(0, len(place), 256):
        e = min(s + 256, len(place))
        for c in range(int(first[s]), int(last[e - 1]), 2048):
            rows, cols = s + np.flatnonzero(~found[s:e]), np.arange(c, min(c + 2048, int(last[e - 1])))
            pair = (np.abs(place[rows][:, None] - place[None, cols]) <= WINDOW) & (rows[:, None] != cols)
            if side is not None:
                pair &= side[rows][:, None] != side[None, cols]
            if pair.any():
                pair = collide(nth, rows, cols, places, marks, pair, count)
                found[rows[pair.any(axis=1)]] = True
                found[cols[pair.any(axis=0)]] = True
    out = np.zeros(len(place), bool)
    out[order] = found
    return out


def _flag(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tables = [], []
        for rows in _runs(batches):
            if rows is not None:
                nth = rows.column("nth")[0].as_py()
                node = rows.column("node").to_numpy()[flag_run(nth, _bytes(rows, "places", np.int8), _bytes(rows, "marks", np.uint16), _side(rows), count)]
                nodes.append(node)
                tables.append(np.full(len(node), nth, np.int32))
            elif nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tables))], ["node", "nth"])
                nodes, tables = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tables))], ["node", "nth"])

    return run


def match_run(nth: int, node: np.ndarray, n: np.ndarray, unit: np.ndarray, places: np.ndarray, marks: np.ndarray, side: np.ndarray | None, count: int, threshold: float, out: _Links) -> None:
    """Links of one run, sorted by its projection: pairs within the window that pass the collision count are verified,
    each in the first table in which it collides."""
    place = places[:, nth % LINES]
    order = np.argsort(place, kind="stable")
    node, n, unit, places, marks, place = node[order], n[order], unit[order], places[order], marks[order], place[order].astype(np.int16)
    side = None if side is None else side[order]
    ends = np.searchsorted(place, place + WINDOW, side="right")
    found_i, found_j = [], []
    for s in range(0, len(node), 256):
        e = min(s + 256, len(node))
        for c in range(s, int(ends[e - 1]), 4096):
            rows, cols = np.arange(s, e), np.arange(c, min(c + 4096, int(ends[e - 1])))
            pair = (cols[None, :] > rows[:, None]) & (place[None, cols] - place[rows, None] <= WINDOW)
            if side is not None:
                pair &= side[rows, None] != side[None, cols]
            if not pair.any():
                continue
            pair = collide(nth, rows, cols, places, marks, pair, count)
            if pair.mean() > 0.05:
                pair &= unit[rows] @ unit[cols].T >= threshold
                i, j = np.nonzero(pair)
            else:
                i, j = np.nonzero(pair)
                near = np.einsum("ij,ij->i", unit[rows][i], unit[cols][j]) >= threshold
                i, j = i[near], j[near]
            found_i.append(i + s)
            found_j.append(j + c)
            if sum(map(len, found_i)) > 1_000_000:
                out.add(node, n, np.concatenate(found_i), np.concatenate(found_j))
                found_i, found_j = [], []
    if found_i:
        out.add(node, n, np.concatenate(found_i), np.concatenate(found_j))


def _match(count: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Links()
        for rows in _runs(batches):
            if rows is None:
                yield out.batch()
                continue
            vec = _lists(rows, "vec", float)
            unit = unit_rows(vec)
            node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy().astype(float)
            match_run(rows.column("nth")[0].as_py(), node, n, unit, _bytes(rows, "places", np.int8), _bytes(rows, "marks", np.uint16), _side(rows), count, threshold, out)
        yield out.batch()

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (nth, key, node, ...) with the runs (nth, key) in one piece each, in order; runs above CROWD rows are dealt over
    pairs (a, b) of blocks, and side tells which of the two a row is from."""
    runs = rows.groupBy("nth", "key").count().filter(F.col("count") > CROWD)
    runs = materialize(runs.select("nth", "key", F.ceil(F.col("count") / (CROWD / 2)).cast("int").alias("blocks")))
    rows = rows.join(runs, ["nth", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).withColumn("far", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"a": F.least("own", "far"), "b": F.greatest("own", "far"), "side": (F.col("own") > F.col("far")).cast("int")}).drop("own", "far", "blocks")
    return rows.repartition("nth", "key", "a", "b").sortWithinPartitions("nth", "key", "a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    n_links counts the other rows with a cosine of `threshold` or more that were found: equal vectors always are, and
    others with the chance RECALL or more, by the calibrated collision count. A first pass over the tables moves only
    places and 16-bit marks, and flags the vectors that have a partner; only these are moved again, with their
    vectors, and only in the tables where a partner is new. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without a vec_id, link with nothing; vectors of different lengths
    don't link. component_id is the smallest vec_id reachable, kept whether it is the row's own. Rows with a repeated
    vec_id count as vectors of their own. Equal vectors are one class and are never expanded into pairs. A run above
    CROWD rows is dealt over pairs of blocks, so that no task holds a crowded run. An empty table gives no rows.
    """
    good = F.size("embedding") > 0
    good &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"))
    rows = rows.withColumn("good", F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False)))
    h = [F.when(F.col("good"), F.xxhash64("embedding", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    rows = rows.select("vec_id", F.when(F.col("good"), F.col("embedding")).alias("vec"), *h)
    classes = rows.filter("vec is not null").groupBy("h0", "h1").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    total = classes.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("rows")).first()
    bits, tables, count = calibrate(total["nodes"], threshold)
    kind = dict(classes.dtypes)["vec"]
    signed = materialize(classes.select("node", "n", "vec").mapInArrow(_signatures(bits, tables), f"node long, n long, vec {kind}, keys array<long>, places binary, marks binary"))
    every = _dealt(signed.select("node", "places", "marks", F.posexplode("keys").alias("nth", "key")))
    flags = materialize(every.select("nth", "key", "a", "b", "side", "node", "places", "marks").mapInArrow(_flag(count), "node long, nth int").distinct())
    some = signed.join(flags.groupBy("node").agg(F.collect_list("nth").alias("tables")), "node")
    some = some.select("node", "n", "vec", "places", "marks", "keys", F.explode("tables").alias("nth")).withColumn("key", F.element_at("keys", F.col("nth") + 1))
    some = _dealt(materialize(some.drop("keys")))
    found = materialize(some.select("nth", "key", "a", "b", "side", "node", "n", "vec", "places", "marks").mapInArrow(_match(count, threshold), "u long, v long, links long"))
    links = found.filter("v < 0").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    groups = components(found.filter("v >= 0").select("u", "v"))
    named = classes.select("node", "h0", "h1", "least", "n").join(links, "node", "left").join(groups, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")))
    named = with_least(named, "component", "least", "component_id", total["nodes"])
    named = materialize(named.select("h0", "h1", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = join_skewed(rows.filter("vec is not null").select("vec_id", "h0", "h1"), named, ["h0", "h1"], F.col("n") > hot_limit(total["rows"] or 0))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    bad = rows.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return out.unionByName(bad)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
