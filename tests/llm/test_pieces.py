"""The coder against the library that defines the result."""

import random
from hashlib import sha256

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import pieces as P

CODER = P.PieceCoder(P.Vocabulary.read(P.vocabulary()))
LIB = sentencepiece.SentencePieceProcessor(model_file=P.vocabulary())


def same(text):
    ids = CODER.encode(text)
    assert ids == LIB.encode(text), repr(text)
    assert CODER.decode(ids) == LIB.decode(ids), repr(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", "hello world", "  hello   world \n\t x\x00y ▁z", " " * 40,
                                  "漢字😀 и кириллица", "a" * 300, "ab" * 200, "\n\n\n", "é" * 9, "x" + " " * 15 + "the",
                                  "▁▁", "<s></s><unk><0x41>", "12345.67 => {}();//", "🏳️‍🌈", "the" * 100])
def test_special(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeionrst \n▁,.Thé", max_size=80))
def test_words_and_runs(text):
    same(text)


def test_random_piece_runs():
    r = random.Random(3)
    for _ in range(2000):
        same("".join(r.choice(CODER.pieces[259:]) for _ in range(r.randint(1, 8))).replace(P.SPACE, " "))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_decode_any_ids(ids):
    assert CODER.decode(ids) == LIB.decode(ids)


def test_query(spark, tmp_path):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "a b", "z"), (1, "hello world", "x"),
            (5, "lorem ipsum " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = P.digest_texts(docs, P.vocabulary()).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        ids = LIB.encode(t or "")
        want[i] = (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(LIB.decode(ids).encode()).hexdigest())
    for g in got:
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == want[g.doc_id]
    assert P.digest_texts(docs.limit(0), P.vocabulary()).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in P.encode_texts(docs, P.vocabulary(), "doc_id", "text").collect():
        assert list(row.ids) == LIB.encode(row.text) and row.decoded == LIB.decode(list(row.ids))
