"""Vector codes against plain Python, and the balls against comparing with every entry."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from ringwatch.llm import codes as C

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    w = width // 4
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in start] for p in range(4)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                part = v[p * w : p * w + w]
                groups.setdefault(near(p, part)[1], []).append(part)
            for k, parts in groups.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out, labels = [], Counter()
    for i, v, lab in kept:
        found = [near(p, v[p * w : p * w + w]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        labels[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, labels[lab], digest) for i, c, e, lab in out)


def report(df):
    return Counter(map(tuple, C.code_report(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_embeddings_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert report(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(k, [round(rng.gauss(0, 1), 1) for _ in range(8)], k % 3) for k in range(300)]
    rows += [(1000, None, 1), (1001, [math.nan] * 8, 1), (1002, [1.0, None] * 4, 1), (1003, [math.inf] + [0.0] * 7, 1), (1004, [0.0] * 8, None), (1005, [-0.0] * 8, None)]
    rows += [(5, rows[9][1], 2), (5, rows[5][1], 2), (None, [1.0] * 8, None), (1006, [0.5] * 3, 1), (1007, [], 1), (1008, [100.0] * 8, 0), (1009, [9000.5] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], KIND + ", code string, x int").repartition(5)
    assert report(df) == brute(rows)


def test_few_vectors_no_vectors_and_no_components(spark):
    few = [(3, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1), (1, [-5.0, 0.0, 0.1], None)]
    assert report(spark.createDataFrame(few, KIND)) == brute(few)
    assert not report(spark.createDataFrame([], KIND)) and not report(spark.createDataFrame([(1, None, 1)], KIND))
    assert report(spark.createDataFrame([(1, [], 1)], KIND)) == Counter([(1, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())])


def test_huge_components_saturate(spark):
    ((_, code, error, *_),) = report(spark.createDataFrame([(1, [1e300] * 4, 1)], KIND))
    assert code == "00000000" and error == 0


@pytest.mark.parametrize(("spread", "big"), [(5, 1), (40, 1), (40, 1 << 18), (0, 1)])
def test_balls_equal_all_entries_and_skip_work(spread, big):
    rng = np.random.default_rng(11)
    centre = rng.integers(-300, 300, (40, 6))
    x = (centre[rng.integers(0, 40, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))) * big
    old, new = C.Codebook(x[:64]), C.Codebook(np.concatenate([x[:32] + rng.integers(-3, 4, (32, 6)), x[32:64]]))
    code = old.nearest(x)[0]
    got, near, work = new.moved(x, code)
    far = ((x[:, None, :] - new.entries[None]) ** 2).sum(axis=2)
    assert (got == far.argmin(axis=1)).all() and (near == far.min(axis=1)).all()
    assert work < far.size / (4 if spread <= 5 else 1)


def test_decoded_vectors_are_near(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    codes, books = C.compress(df)
    back = {r.vec_id: r for r in C.decoded(codes, books).collect()}
    x = {r.vec_id: np.array(r.embedding) for r in df.collect() if r.embedding is not None}
    for k, r in back.items():
        assert abs(float(((np.array(r.decoded) - x[k]) ** 2).sum()) - r.error / 1024**2) < 0.02
