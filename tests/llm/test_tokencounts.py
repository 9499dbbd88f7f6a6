"""Token counts: the library's own counts, what the cache serves, what it appends."""

from collections import Counter

import public_tokenizers
import pytest

from ringwatch.llm import tokencounts as T

from .conftest import KIND, ODD, row

MODEL, BYTES, WORDS = (str(public_tokenizers.path(n)) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t or ""))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t or "", add_special_tokens=False).ids)


def stored(spark, cache, path):
    return spark.read.parquet(f"{cache}/version={T.tokenizer_version(path)}").count()


@pytest.mark.parametrize("path", [MODEL, BYTES, WORDS])
def test_odd_texts_equal_the_library(spark, odd, tmp_path, path):
    more = spark.createDataFrame([row(900, "a  b\n\n c\t"), row(901, "a b c "), row(902, "<|endoftext|> x <s>"), row(903, "Å    b")], KIND)
    docs = odd.select("doc_id", "text", "score").unionByName(more.select("doc_id", "text"), allowMissingColumns=True)
    got = Counter(map(tuple, T.count_tokens(docs, path, str(tmp_path / "c"), limit=100).collect()))
    count = library(path)
    assert got == Counter((r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 100) for r in docs.collect())


def test_the_cache_serves_known_texts_and_takes_only_new_ones(spark, tmp_path):
    cache = str(tmp_path / "c")
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(["one two", "one two", "three", None, ""])], KIND)
    T.count_tokens(docs, MODEL, cache).collect()
    assert stored(spark, cache, MODEL) == 3
    assert not T.count_tokens(docs.filter("false"), MODEL, cache).collect()
    grown = docs.union(spark.createDataFrame([row(9, "three"), row(10, "new"), row(11, "new")], KIND))
    first = sorted(map(tuple, T.count_tokens(grown, MODEL, cache).collect()))
    assert stored(spark, cache, MODEL) == 4
    T.count_tokens(docs, WORDS, cache).collect()
    assert stored(spark, cache, MODEL) == 4 and stored(spark, cache, WORDS) == 3
    # a count that two runs appended at once is one row; counts are read from the cache, not computed again
    spark.read.parquet(f"{cache}/version={T.tokenizer_version(MODEL)}").selectExpr("digest", "n_tokens + 1000L as n_tokens").write.mode("append").parquet(f"{cache}/version={T.tokenizer_version(MODEL)}")
    again = sorted(map(tuple, T.count_tokens(grown, MODEL, cache).collect()))
    assert [(r[0], r[2]) for r in again] == [(r[0], r[2] + 1000) for r in first]


def test_many_misses_meet_by_a_shuffle(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_BYTES", 0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    T.count_tokens(docs.filter("doc_id % 9 = 0"), MODEL, str(tmp_path / "c")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(docs, MODEL, str(tmp_path / "c")).collect()}
    count = library(MODEL)
    assert got == {r.doc_id: (len((r.text or "").encode()), count(r.text), count(r.text) > 4096) for r in docs.collect()}
    assert stored(spark, str(tmp_path / "c"), MODEL) == docs.select("text").na.fill("").distinct().count()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        T.token_counter("x.tiktoken")


def test_the_query_takes_the_cache_that_the_session_names(spark, sf, tmp_path):
    cache = str(tmp_path / "c")
    spark.conf.set(T.CACHE_SETTING, cache)
    try:
        first, again = (Counter(map(tuple, T.op11_token_counts(spark, sf).collect())) for _ in range(2))
    finally:
        spark.conf.unset(T.CACHE_SETTING)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text").na.fill("").distinct().count()
    assert first == again == Counter(map(tuple, T.op11_token_counts(spark, sf).collect())) and stored(spark, cache, MODEL) == texts
