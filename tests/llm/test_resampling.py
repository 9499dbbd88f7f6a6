"""Importance resampling: buckets, totals, weights and draws against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ringwatch.llm import resampling as R

from .conftest import KIND, row

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(docs, target):
    s, t = Counter(), Counter()
    for r in docs:
        s.update(buckets_of(r.text))
    for r in target:
        t.update(buckets_of(r.text))
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for r in docs:
        found = buckets_of(r.text)
        h = int(hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([r.doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(r.text))])
    order = sorted((k for k in range(len(rows)) if rows[k][5] >= 20), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for place, k in enumerate(order[: len(order) * 5 // 100], 1):
        rows[k][4] = place
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("share", [1.0, 0.3, 0.0])
def test_any_head_gives_the_buckets_of_the_bytes(share):
    """Runs with all, some and none of their words in the head, with and without frequent pairs."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcxyz019é中", k=rng.randint(1, 9))) for _ in range(60)] + ["w" * 64, "v" * 65, "a"]
    texts = [rng.choice([" ", "-", "\n", "\x7f", ", "]).join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(50)] + [None, "", "...", "one", "a\x00b"]
    head = R.Head(sorted(w.encode() for w in vocabulary if len(w.encode()) <= 64 and rng.random() < share))
    n = len(head.crc)
    pairs = np.array([(rng.randrange(n) << 32) | rng.randrange(n) for _ in range(500)] if n else [], np.int64)
    for h in (head, R.Head(head.words.to_pylist(), np.unique(pairs))):
        words = R.split_words(pa.array(texts).slice(3))
        got = [[] for _ in texts]
        for doc, bucket in R.feature_buckets(words, h, R._head_ids(words, h)):
            for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
                got[d + 3].append(b)
        assert [sorted(g) for g in got[3:]] == [sorted(buckets_of(t)) for t in texts[3:]]


def test_joined_crc():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.bytes(int(rng.integers(0, 90))), rng.bytes(int(rng.integers(0, 65)))
        got = R.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]), np.array([zlib.crc32(b)], np.uint32))
        assert int(got[0]) == zlib.crc32(a + b)


def test_documents_against_brute_force(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    got = Counter(map(tuple, R.op12_importance_resampling(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()))
    assert got == brute(docs.collect(), target.collect())


def test_odd_texts_ties_and_repeats(spark, odd, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 1000)
    target = spark.createDataFrame([(1, "same words here again and again"), (2, None), (3, "")], "item_id long, text string")
    more = spark.createDataFrame([row(k // 2, "the same twenty words " * 6) for k in range(100, 200)], KIND)
    docs = odd.select("doc_id", "text", "score").unionByName(more.select("doc_id", "text"), allowMissingColumns=True)
    got = Counter(map(tuple, R.resample(docs, target).collect()))
    assert got == brute(docs.collect(), target.collect())
    drawn = sorted(r[4] for r in got.elements() if r[4])
    assert drawn == list(range(1, len(drawn) + 1)) and drawn


def test_empty_tables(spark, empty):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert not R.resample(empty, target).collect()
    docs = spark.createDataFrame([row(1, "a b c")], KIND)
    (got,) = R.resample(docs, target.filter("false")).collect()
    assert got.n_features == 6 and got.rank is None


def test_head_words_are_the_frequent_ones_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "HEAD_SHARE", 0.3)
    docs = spark.createDataFrame([row(1, "often rare " + "x" * 99), row(2, "Often other"), row(3, "often"), row(4, None)], KIND)
    assert R.head_vocabulary(docs).words.to_pylist() == [b"often"]
