import re

import numpy as np
import xxhash

from ringwatch.llm import components, simhash
from ringwatch.llm.common import Forest

from .conftest import ODD


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles)) if shingles else 0


def brute_groups(prints):
    ids, parent = sorted(prints), {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_fingerprints():
    for t in [*ODD, "a b", "A b C", "x y z x y z", "à b\xa0c d"]:
        assert simhash.fingerprint(None if t is None else t.encode()) % (1 << 64) == brute_fingerprint(t)


def test_query_is_brute_force(spark, sf, documents):
    prints = {k: brute_fingerprint(r.text) for k, r in documents.items()}
    groups = brute_groups(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op9_simhash_near_dedup(spark, sf).collect()}
    assert got == {k: (prints[k], groups[k]) for k in prints}


def test_tiles_of_any_size_find_all_links(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60)
    near = [int(b) ^ sum(1 << int(x) for x in r.integers(0, 63, k)) for b in base for k in (0, 1, 2, 3, 4)]
    prints = sorted({0, 7, 15, *near})
    groups = brute_groups(dict(zip(prints, prints, strict=True)))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for n, block in ((300, 10_000), (300, 2), (100_000, 5_000), (1 << 40, 5_000)):  # widths 8, 2, 4 and 1
        found = {x.node: x.component for x in components.components(simhash.near_edges(df, n, block=block)).collect()}
        assert {p: found.get(p, p) for p in prints} == groups


def test_odd_rows(spark, odd, empty):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.simhash_groups(empty).collect() == []


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)] + [(3, 3), (None, 4), (501, 500)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(101, 161), 100), **dict.fromkeys(range(501, 560), 500)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_random_graphs_with_hubs(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(7, k) for k in range(1000, 1300)] + [(k, 9999) for k in range(1200, 1500)]
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                label[k] = x
    found = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k: found.get(k, k) for k in label} == {k: min(g) for k, g in label.items()}


def test_forest():
    r = np.random.default_rng(0)
    i, j = r.integers(0, 300, 200), r.integers(0, 300, 200)
    forest = Forest(300)
    for k in range(0, 200, 50):
        forest.add(i[k : k + 50], j[k : k + 50])
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(i, j, strict=True):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert forest.label.tolist() == [find(x) for x in range(300)]
