import numpy as np
import pytest

from ringwatch.llm import embeddings


def brute(rows, threshold=0.95):
    good = [(k, v) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {n: [] for n in range(len(good))}
    for n, (_, v) in enumerate(good):
        for m in range(n):
            w = good[m][1]
            if len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[n].append(m)
                links[m].append(n)
    label = list(range(len(good)))
    for n in range(len(good)):
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        label[n] = min(good[x][0] for x in seen)
    return sorted((k, len(links[n]), label[n]) for n, (k, _) in enumerate(good))


def test_groups_of_copies_and_near_copies(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((120, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(200 + k, (base[k % 5] + 0.05 * r.standard_normal(32)).tolist()) for k in range(60)]
    rows += [(300 + k, base[7].tolist()) for k in range(30)] + [(400, (base[8] * 3).tolist()), (5, base[5].tolist())]
    odd = [(500, None), (501, []), (502, [0.0] * 32), (503, [None] + [1.0] * 31), (504, [float("nan")] * 32), (505, [1.0, 2.0]), (None, base[9].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as node", "'x' as links")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    bad = {500, 501, 502, 503, 504, None}
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got if x.vec_id not in bad) == brute(rows + odd)
    assert all(x.n_links == 0 and x.component_id == x.vec_id and x.kept == (x.vec_id is not None) for x in got if x.vec_id in bad)


def test_crowded_runs_are_dealt_over_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    one = r.standard_normal(16)
    rows = [(k, (one + 0.02 * r.standard_normal(16)).tolist()) for k in range(150)]
    monkeypatch.setattr(embeddings, "CROWD", 20)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == brute(rows)


def test_recall_at_the_threshold():
    r = np.random.default_rng(0)
    for n in (500, 50_000, 10_000_000):
        bits, tables, count = embeddings.calibrate(n)
        u = r.standard_normal((4000, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = r.standard_normal((4000, 64))
        w -= (w * u).sum(axis=1, keepdims=True) * u
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        v = 0.95 * u + np.sqrt(1 - 0.95**2) * w
        known = embeddings.directions(64, bits, tables)
        (a, x), (b, y) = (embeddings.sign(z, bits, tables, known) for z in (u, v))
        near = np.abs(x - y) <= embeddings.WINDOW
        met = ((a == b) & near[:, np.arange(tables) % embeddings.LINES]).any(axis=1)
        assert (met & (near.sum(axis=1) >= count)).mean() > 0.985
        far = np.abs(x[:-1] - x[1:]) <= embeddings.WINDOW
        assert (far.sum(axis=1) >= count).mean() < 0.05


def test_a_pair_is_found_in_its_first_table_only():
    r = np.random.default_rng(1)
    base = r.standard_normal((200, 16))
    u = np.concatenate([base, base + 0.05 * r.standard_normal((200, 16))])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    keys, places = embeddings.sign(u, 3, 12, embeddings.directions(16, 3, 12))
    marks, out = embeddings.marks_of(keys), embeddings._Links()
    seen, count = np.zeros(400), embeddings.calibrate(400)[2]
    for t in range(12):
        for key in np.unique(keys[:, t]):
            at = np.flatnonzero(keys[:, t] == key)
            flags = at[embeddings.flag_run(t, places[at], marks[at], None, count)]
            embeddings.match_run(t, flags, np.ones(len(flags)), u[flags], places[flags], marks[flags], None, count, 0.95, out)
    found = out.batch()
    for a, v, n in zip(*(found.column(k).to_pylist() for k in range(3)), strict=True):
        seen[a] += n if v < 0 else 0
    assert (seen == (u @ u.T >= 0.95).sum(axis=1) - 1).mean() > 0.98 and (seen <= (u @ u.T >= 0.95).sum(axis=1) - 1).all()


def test_query_on_the_driver_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in embeddings.op4_embedding_near_dedup(spark, sf).collect()) == brute(rows)


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("scale", [1e170, 1e-170, 1e300, 5e-324, 1.0])
def test_extreme_magnitudes(spark, scale):
    """Cosines don't depend on the size of the numbers: squares neither overflow nor vanish."""
    ones = [[1.0, 2.0, 3.0, 5.0], [1.0, 2.0, 3.0, 6.0], [-1.0, 2.0, 3.0, 5.0], [5.0, 0.0, 0.0, 1.0]]
    if scale == 5e-324:
        ones = [[1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 2.0], [1.0, -1.0, 1.0, 1.0], [0.0, 0.0, 1.0, 0.0]]
    df = spark.createDataFrame([(k, [x * scale for x in v]) for k, v in enumerate(ones)], "vec_id long, embedding array<double>")
    unit = embeddings.unit_rows(np.array([[x * scale for x in v] for v in ones]))
    assert np.allclose((unit * unit).sum(axis=1), 1)
    cosines = unit @ unit.T
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert got == {k: int((cosines[k] >= 0.95).sum()) - 1 for k in range(4)}
