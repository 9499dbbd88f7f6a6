import duckdb
import pytest

from ringwatch.llm import mixing

from .conftest import KIND, row


COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "first_position", "n_copies"]


def test_same_rows_as_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({mixing.OP1_SQL})").fetchall())
    rows = mixing.op1_mix_sources(spark, sf).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in rows) == expected
    positions = [r.first_position if r.n_copies else 2.0 for r in rows]
    assert positions == sorted(positions) and min(positions) < 0.1


def targets(spark, sizes, weights, budget, **settings):
    sums = spark.createDataFrame([(f"s{k:03}" if k or len(sizes) > 3 else None, n, 1) for k, n in enumerate(sizes)], "source string, size long, n long")
    weights = weights if len(sizes) > 3 else [*weights[1:], weights[0]]
    rows = mixing.plan_sources(sums, lambda k, _: [(0.0, weights[k % len(weights)]), (1.0, weights[k % len(weights)])], budget, 2.0).collect()
    assert sorted(r["rank"] for r in rows) == list(range(len(sizes)))
    return [r.target for r in sorted(rows, key=lambda r: (r.source is not None, r.source))]


def test_share_stops_at_the_limit(spark):
    assert targets(spark, [10, 10, 10], [3, 1, 2], 1.5) == [20, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert targets(spark, [1, 1, 100], [3, 1, 2], 1.5) == [2, 2, 149]
    assert targets(spark, [0, 0, 0], [1, 2, 3], 1.5) == [0, 0, 0] and targets(spark, [5, 5, 5], [1, 2, 3], 9) == [10, 10, 10]
    many = targets(spark, [k % 7 for k in range(500)], [3, 1, 2], 1.5)
    assert sum(many) == pytest.approx(1.5 * sum(k % 7 for k in range(500))) and all(t <= 2 * (k % 7) for k, t in enumerate(many))


def test_many_sources_without_broadcast(spark, odd, monkeypatch):
    docs = spark.createDataFrame([row(k, "w " * (k % 5), source=None if k % 11 == 0 else f"s{k % 60}") for k in range(600)] + [row(None, f"a b {k}") for k in range(50)], KIND)
    get = lambda: sorted((str(r.doc_id), r.source or "", r.mix.size, r.mix.target, r.mix.taken) for r in mixing.plan_mix(docs, mixing.production_schedule).collect())
    expected = get()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert get() == expected and len(expected) == 650


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_whatever_the_buckets(spark, odd, bucket):
    rows = mixing.plan_mix(odd, mixing.production_schedule, bucket=bucket)
    assert rows.columns == [*odd.columns, "mix"]
    got = sorted((str(r.doc_id), str(r.source), r.mix.size, r.mix.target, r.mix.taken) for r in rows.collect())
    again = sorted((str(r.doc_id), str(r.source), r.mix.size, r.mix.target, r.mix.taken) for r in mixing.plan_mix(odd, mixing.production_schedule).collect())
    assert got == again and len(got) == odd.count()
    for source in {g[1] for g in got}:
        own = [g for g in got if g[1] == source]
        assert abs(sum(g[4] for g in own) - own[0][3]) <= max(g[2] for g in own) / 2 and all(g[4] in (0, g[2], 2 * g[2]) for g in own)


def test_positions_invert_demand(spark):
    docs = spark.createDataFrame([row(k, "w " * 10, source="s") for k in range(200)], KIND)
    copies = sorted(c.position for r in mixing.plan_mix(docs, lambda *_: [(0.0, 3.0), (0.5, 1.0), (1.0, 0.0)]).collect() for c in r.mix.copies)
    demand = lambda t: 3 * t - 2 * t * t if t <= 0.5 else 1 + (t - 0.5) - (t - 0.5) ** 2
    assert len(copies) == 300
    assert all(abs(demand(t) / demand(1) - (k + 0.5) / 300) < 1e-9 for k, t in enumerate(copies))


def test_sequence(spark, odd, empty):
    rows = mixing.mix_sources(odd, mixing.production_schedule)
    assert rows.columns == odd.columns
    plan = [r for r in mixing.plan_mix(odd, mixing.production_schedule).collect() for _ in r.mix.copies]
    assert sorted(str(r.text) for r in rows.collect()) == sorted(r.text for r in plan)
    assert mixing.mix_sources(empty, mixing.production_schedule).collect() == []
    assert mixing.plan_mix(empty, mixing.production_schedule).collect() == []


def test_texts_stay_whole_where_a_document_exceeds_the_target(spark):
    docs = spark.createDataFrame([row(1, "w " * 100, source="a"), row(2, "v " * 90, source="b"), row(3, "u " * 10, source="b"), row(4, "", source="c"), row(5, None, source="d")], KIND)
    flat = lambda rank, _: [(0.0, (1.0, 1.0, 1.0, 0.0)[rank]), (1.0, (1.0, 1.0, 1.0, 0.0)[rank])]
    texts = {r.text for r in docs.collect()}
    for budget in (0.2, 0.7, 1.5):
        assert {r.text for r in mixing.mix_sources(docs, flat, budget).collect()} <= texts
    assert all(r.mix.taken in (0, r.mix.size, 2 * r.mix.size) for r in mixing.plan_mix(docs, flat, 0.7).collect())


@pytest.mark.parametrize("most", [mixing.BROADCAST_BYTES, 0])
def test_training_order_of_written_files(spark, tmp_path, monkeypatch, most):
    """Places follow the files as they were written, however Spark packs them by size when it reads them."""
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([row(k, "w " * (1 + (k * 37) % 90), source=f"s{k % 5}") for k in range(400)], KIND)
    sequence = mixing.mix_sources(docs, mixing.production_schedule)
    sequence.write.parquet(str(tmp_path / "mix"))
    back = mixing.training_order(spark.read.parquet(str(tmp_path / "mix"))).orderBy("position").collect()
    assert [r.position for r in back] == list(range(1, len(back) + 1))
    copies = sorted((c.position, r.doc_id) for r in mixing.plan_mix(docs, mixing.production_schedule).collect() for c in r.mix.copies)
    assert [r.doc_id for r in back] == [k for _, k in copies]
    assert [r.position for r in mixing.training_order(docs).limit(2).collect()] == [None, None]
