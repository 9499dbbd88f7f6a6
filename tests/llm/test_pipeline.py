import re

import corpus_pipeline
from ringwatch.llm import mixing, pieces, quality, secrets
from ringwatch.llm.common import materialize, table

from .conftest import KIND, row
from .test_simhash import brute_fingerprint, brute_groups


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    every = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = materialize(stages["quality classifier"](spark, docs, sf))
    model = quality.fit_on(docs, table(spark, sf, "labels"))
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, model).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(r["doc_id"] for r in every if scores[r["doc_id"]])
    distinct = materialize(stages["SimHash near-dedup"](spark, good, sf))
    groups = brute_groups({r.doc_id: brute_fingerprint(r.text) for r in good.collect()})
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(k for k, v in groups.items() if k == v)
    hidden = materialize(stages["secret scans"](spark, distinct, sf))
    before = {r.doc_id: r.text for r in distinct.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in hidden.collect()} == {k: (t := secrets.redact(v), len(t)) for k, v in before.items()}
    mixed = materialize(stages["source mixing"](spark, hidden, sf))
    for df in (good, distinct, hidden, mixed):
        assert df.columns == docs.columns
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    most = {s: max(len((r.text or "").split()) for r in hidden.collect() if r.source == s) for s in {r.source for r in hidden.collect()}}
    assert abs(words(mixed.collect()) - 1.5 * words(hidden.collect())) <= sum(most.values()) / 2
    assert {r.text for r in mixed.collect()} <= {r.text for r in hidden.collect()}
    last = stages["SentencePiece"](spark, mixed, sf).collect()
    got = sorted((r.position, r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted((r.position, r.doc_id, r.n_tokens, r.ids_sha256) for r in last) and len(got) == mixed.count()
    copies = sorted((c.position, r.doc_id) for r in mixing.plan_mix(hidden, mixing.production_schedule).collect() for c in r.mix.copies)
    assert [g[:2] for g in got] == [(k, d) for k, (_, d) in enumerate(copies, 1)]
    assert pieces.token_digests(mixed, pieces.model_path()).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_repeated_rows_leave_one(spark, sf):
    rows = [row(1, "a b c d"), row(1, "a b c d"), row(2, "a b c d"), row(None, "other words entirely here"), row(None, "other words entirely here")]
    got = corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, KIND), sf).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: str(r.doc_id))] == [1, None]


def test_dropped_ids_by_broadcast_or_shuffle(spark, sf, monkeypatch):
    texts = ["a b c d e", "p q r s t", "a b c d e", "one two three four"]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], KIND)
    for most in (1 << 20, 0):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", most)
        assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, sf).collect()) == [0, 1, 3]


def test_stages_take_odd_and_empty_tables(spark, odd, empty, sf):
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf))
        assert docs.columns[0] == "doc_id"
