"""Target-distribution importance resampling over hashed word runs, with a head vocabulary of CRC states."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

BUCKETS, RUN, LEAST_WORDS, SEED = 10_000, 3, 20, 42
#: A word (a pair of head words) is frequent from this share of all words (pairs) on, so there are at most 131,072 of each.
HEAD_SHARE = 1 / (1 << 17)
#: Bytes of a head word at most; bytes of texts worked on at once.
WORD_BYTES, CHUNK = 64, 1 << 21
_CODE = np.arange(256)
#: Each byte in lower case; 0 for bytes that are in no word.
_LOWER = np.where((_CODE >= 0x80) | ((_CODE >= 0x30) & (_CODE < 0x3A)) | ((_CODE >= 0x61) & (_CODE < 0x7B)), _CODE, np.where((_CODE >= 0x41) & (_CODE < 0x5B), _CODE + 32, 0)).astype(np.uint8)


def _shifts(most: int) -> np.ndarray:
    """[bytes, place, value]: the CRC-32 state that a state with `value` at byte `place` becomes behind so many zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    out = [state]
    for _ in range(most):
        state = (state >> 8) ^ step[state & 255]
        out.append(state)
    return np.stack(out)


_SHIFT = _shifts(WORD_BYTES + 1).ravel()


def joined_crc(left: np.ndarray, length: np.ndarray, right: np.ndarray) -> np.ndarray:
    """CRC-32 of a text followed by another of `length` bytes, from the CRC-32 of both."""
    at = length.astype(np.int64) << 10
    out = right.copy()
    for place in range(4):
        out ^= _SHIFT[at + (place << 8) + ((left >> np.uint32(8 * place)) & np.uint32(255))]
    return out


class Head:
    """Frequent words with their CRC states, and frequent pairs of them with CRC and bucket.

    Any set of words and pairs gives the same features; the frequent ones give them fastest."""

    def __init__(self, words: list[bytes], pairs: np.ndarray | None = None):
        self.words = pa.array(words, pa.binary())
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.after = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        keys = np.zeros(0, np.int64) if pairs is None else pairs.astype(np.int64)
        self.bits = max(1, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.pair = np.zeros(1 << self.bits, np.uint32)
        if len(keys):  # pairs that share a slot leave it to the last one; the others are put together from their words
            a, b = keys >> 32, keys & 0xFFFFFFFF
            slot = self._slot(keys)
            self.key[slot] = keys
            self.pair[slot] = np.where(self.key[slot] == keys, joined_crc(self.crc[a], self.length[b], self.after[b]), self.pair[slot])
        self.bucket = (self.pair % BUCKETS).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC and bucket of pairs of head words, by their positions."""
        key = (a << 32) | b
        slot = self._slot(key)
        crc, bucket = self.pair[slot], self.bucket[slot]
        rest = np.flatnonzero(self.key[slot] != key)
        if len(rest):
            crc[rest] = joined_crc(self.crc[a[rest]], self.length[b[rest]], self.after[b[rest]])
            bucket[rest] = crc[rest] % BUCKETS
        return crc, bucket


@dataclass
class Words:
    """The words of some texts: bytes with one space behind each word, where each starts and ends, and its text."""

    line: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    values: pa.Array


def split_words(texts: pa.Array) -> Words:
    """The lower-cased words of an array of UTF-8 texts; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = _LOWER[np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]] if data is not None and edge[-1] > edge[0] else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    inside = np.r_[False, flat > 0, False]
    cut = np.zeros(len(flat) + 1, bool)
    cut[edge] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    size = end - start
    chars = flat[flat > 0]
    last = np.cumsum(size)
    values = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, last].astype(np.int64).tobytes()), pa.py_buffer(chars.tobytes())])
    line = np.full(len(chars) + len(size), 32, np.uint8)
    line[np.arange(len(chars)) + np.repeat(np.arange(len(size)), size)] = chars
    at = last - size + np.arange(len(size))
    return Words(line.tobytes(), at, at + size, np.searchsorted(edge, start, "right") - 1, values)


def feature_buckets(words: Words, head: Head, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of all runs of one, two and three words. ids: each word's position in the head, or -1.

    Runs of head words come from states and pairs; a run with any other word is the CRC-32 of its bytes."""
    known = ids >= 0
    crc = np.zeros(len(ids), np.uint32)
    crc[known] = head.crc[ids[known]]
    direct, line = zlib.crc32, words.line
    for n in range(1, min(RUN, len(ids)) + 1):
        m = len(ids) - n + 1
        whole = words.doc[:m] == words.doc[n - 1 :]
        heads = whole & known[:m] if n == 1 else heads[:m] & known[n - 1 :] & whole
        bucket = np.zeros(m, np.int32)
        at = np.flatnonzero(heads)
        if n == 1:
            bucket[at] = crc[at] % BUCKETS
        elif n == 2:
            pair, bucket[at] = head.pairs(ids[at], ids[at + 1])
            crc = np.zeros(m, np.uint32)
            crc[at] = pair
        else:
            last = ids[at + n - 1]
            more = np.zeros(m, np.uint32)
            more[at] = joined_crc(crc[at], head.length[last], head.after[last])
            crc = more
            bucket[at] = crc[at] % BUCKETS
        tail = np.flatnonzero(whole & ~heads)
        if len(tail):
            ends = words.end[tail + n - 1].tolist()
            bucket[tail] = np.fromiter((direct(line[a:b]) % BUCKETS for a, b in zip(words.start[tail].tolist(), ends, strict=True)), np.int32, len(tail))
        yield words.doc[:m][whole], bucket[whole]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with CHUNK bytes of text, or one longer text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right"))
            upto = max(upto, at + 1)
            yield b.slice(at, upto - at)
            at = upto


def _head_ids(words: Words, head: Head) -> np.ndarray:
    return pc.fill_null(pc.index_in(words.values.cast(pa.binary()), value_set=head.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _chunks(batches):
        found = pc.value_counts(split_words(b.column("text")).values)
        word = found.field(0)
        short = pc.less_equal(pc.binary_length(word), WORD_BYTES)
        more = pa.array([None], pa.binary()), pa.array([pc.sum(pc.filter(found.field(1), pc.invert(short))).as_py() or 0], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pc.filter(word, short).cast(pa.binary()), more[0]]), pa.concat_arrays([pc.filter(found.field(1), short), more[1]])], ["word", "n"])


def _census(head: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for b in _chunks(batches):
            words = split_words(b.column("text"))
            ids = _head_ids(words, head.value)
            for _, bucket in feature_buckets(words, head.value, ids):
                totals += np.bincount(bucket, minlength=BUCKETS)
            both = (ids[:-1] >= 0) & (ids[1:] >= 0) & (words.doc[:-1] == words.doc[1:])
            pair, n = np.unique((ids[:-1][both] << 32) | ids[1:][both], return_counts=True)
            often = n >= HEAD_SHARE * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(often.sum(), bool)), pa.array(pair[often]), pa.array(n[often].astype(np.int64))], ["pair", "key", "n"])
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), bool)), pa.array(at), pa.array(totals[at])], ["pair", "key", "n"])

    return run


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("text").cast("string").cast("binary").alias("text"))


def head_vocabulary(docs: DataFrame) -> Head:
    """The words that make up HEAD_SHARE or more of all words of docs, counted over all texts."""
    counts = materialize(_texts(docs).mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    return Head(sorted(bytes(r[0]) for r in counts.filter((F.col("n") >= HEAD_SHARE * n) & F.col("word").isNotNull()).select("word").collect()))


def bucket_totals(docs: DataFrame, head: Head) -> tuple[np.ndarray, Head]:
    """How many features of docs fall in each bucket, exactly; and the head with the frequent pairs that the same pass counts.

    A pair counts where it makes up HEAD_SHARE of a chunk of texts: a pair that reaches this share of all words does so
    in some chunk, and what is left out changes the speed of a feature, never its bucket."""
    spark = docs.sparkSession
    rows = materialize(_texts(docs).mapInArrow(_census(spark.sparkContext.broadcast(head)), "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n")))
    totals = np.zeros(BUCKETS, np.int64)
    for key, n in rows.filter(~F.col("pair")).select("key", "n").collect():
        totals[key] = n
    pairs = rows.filter(F.col("pair") & (F.col("n") >= HEAD_SHARE / RUN * float(totals.sum()))).select("key").collect()
    return totals, Head(head.words.to_pylist(), np.array([r[0] for r in pairs], np.int64))


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) (S + buckets)) / ((s + 1) (T + buckets)))) of each bucket."""
    t, s = target.astype(float), source.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weights(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gains = model.value
        for b in _chunks(batches):
            words = split_words(b.column("text"))
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for doc, bucket in feature_buckets(words, head, _head_ids(words, head)):
                n += np.bincount(doc, minlength=b.num_rows)
                weight += np.bincount(doc, gains[bucket], b.num_rows)
            n_words = np.bincount(words.doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n_words, n, weight.astype(np.int64)))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with their place in the given order, from 1, as a new column `place`: range partitions are counted, and a row's
    place is its place inside its partition behind the rows of the partitions before it."""
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range partition
    rows = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return rows.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


def importance_weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs (doc_id, text): the log ratio of the target's bucket
    frequencies to those of docs, in thousandths, summed over the row's features."""
    source, head = bucket_totals(docs, head_vocabulary(docs))
    model = docs.sparkSession.sparkContext.broadcast((head, bucket_gains(bucket_totals(target, head)[0], source)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_weights(model), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text): an importance resample of `percent` in
    a hundred of the documents with at least `least_words` words, in the likeness of the texts of target.

    score is the weight plus Gumbel noise of sha256('seed:doc_id'); the highest scores are drawn, ties to the smaller
    doc_id, and rank counts them from 1; it is null for rows that aren't drawn. A null text has no words and weight 0. A
    null doc_id has the noise of an empty id and comes last among ties. Repeated rows are drawn one by one. No target or
    no words leave all buckets equally likely there. Other columns are ignored."""
    rows = materialize(importance_weights(docs, target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / float(1 << 32))))
    rows = rows.withColumn("score", F.col("weight") + noise)
    enough = F.col("n_words") >= least_words
    drawn = rows.filter(enough).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    placed = numbered(rows.filter(enough), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    placed = placed.select(*out, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return placed.unionByName(rows.filter(~enough).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
