"""Encoding and decoding against the library itself."""

import hashlib
import random

import pytest

from corpusloom.llm import piece_codec
from corpusloom.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return piece_codec.PieceCodec(MODEL)


def texts():
    rng = random.Random(4)
    parts = ["a", "b", "e", "th", "in", "▁", " ", "  ", "\n", "\t", "é", "日", "😀", "\x00", "ing", "1", "2", "0", "==", "-", "the", " the", "�", "A", "er", "<s>", "<0x41>", ".", ","]
    return ["", " ", "\n", "word", "x" * 5000, "▁▁ ▁"] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2500)]


def test_same_ids_and_text_as_the_library(library, own):
    for t in texts():
        ids = library.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)
        assert own.coded(t) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_decoding_any_ids(library, own):
    rng = random.Random(9)
    for _ in range(2000):
        ids = [rng.randrange(600) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids)


def test_small_caches_give_the_same(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_ENTRIES", 3)
    own = piece_codec.PieceCodec(MODEL)
    for t in texts()[:300]:
        assert own.coded(t)[1] == ",".join(map(str, library.encode(t)))


def test_given_documents_through_spark(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = piece_codec.encode_and_decode(docs, MODEL, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    assert got.columns == [*docs.columns, "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        ids = library.encode(r.text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "old", 1), (1, None, "old", 1), (None, "a b", None, None)], "doc_id long, text string, n_tokens string, ids int")
    got = piece_codec.encode_and_decode(df, MODEL)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in got.collect()) == [("1", 0, ""), ("1", 0, ""), ("None", 2, "a b")]
    assert piece_codec.encode_and_decode(df.limit(0), MODEL).count() == 0
    back = piece_codec.decode_ids(got.select("ids"), MODEL).collect()
    assert sorted(r.decoded for r in back) == ["", "", "a b"]
