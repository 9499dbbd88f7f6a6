import hashlib
import random

import pytest

from ringwatch.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_path())


def encode(model, texts):
    return [b",".join(s[1] for s in segments).decode() for segments in model.encode(texts)]


def test_encodes_like_the_library(model, library):
    random.seed(1)
    parts = ["a", "b", "e", "t", " ", "  ", "▁", "\n", "\t", "é", "中", "😀", "aa", "ing", "the", "\x00", "Ａ", "퟿", "0", "--", "==", "     ", "th", "ab", "x"]
    texts = ["".join(random.choice(parts) for _ in range(random.choice([0, 1, 2, 5, 20, 60]))) for _ in range(6000)] + ["a" * 9000, " " * 50, "ab" * 3000, "thequickbrown" * 700]
    for at in range(0, len(texts), 256):
        own = texts[at : at + 256]
        for text, got in zip(own, encode(model, own), strict=True):
            ids = library.encode(text)
            assert got == ",".join(map(str, ids))
            assert model.decode(ids) == library.decode(ids)


def test_heap_and_rounds_agree(model):
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice("etaoin shrdlu0.") for _ in range(80)).replace(" ", "")
        sym, count = model.symbols([text])
        assert sym.tolist() == model._long(text).tolist() and count.tolist() == [len(sym)]


def test_decodes_any_ids_like_the_library(model, library):
    random.seed(2)
    for k in range(4000):
        ids = [random.randrange(32_000 if k % 2 else 300) for _ in range(random.randrange(12))]
        assert model.decode(ids) == library.decode(ids)


def test_query_is_the_library(spark, sf, documents, library):
    for r in pieces.op5_sentencepiece(spark, sf).collect():
        ids = library.encode(documents[r.doc_id].text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_and_odd_rows(odd, empty):
    back = pieces.decode_documents(pieces.encode_documents(odd, pieces.model_path()), pieces.model_path())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert pieces.token_digests(odd, pieces.model_path()).count() == odd.count() and pieces.token_digests(empty, pieces.model_path()).collect() == []
