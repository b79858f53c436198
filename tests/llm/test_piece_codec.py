import contextlib
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from histloom.llm import piece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SIGNS = st.sampled_from(list("abteoin T.,;()#*'\"/\\\n\t0129-_▁éüßñ梦😀　 ²ªـ́​"))


@settings(max_examples=400, deadline=None)
@given(st.lists(SIGNS, max_size=60).map("".join) | st.text(max_size=40))
def test_encodes_as_the_library(text):
    assert piece_codec.codec(MODEL).encode(text) == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abteoinrsgl▁é,.", max_size=24))
def test_both_agendas_agree(monkeypatch_short, word):
    own = piece_codec.codec(MODEL)
    short = own.agenda(word)
    with monkeypatch_short():
        assert own.agenda(word) == short


@pytest.fixture(scope="module")
def monkeypatch_short():
    @contextlib.contextmanager
    def without_lists():
        old, piece_codec.SHORT = piece_codec.SHORT, 0
        yield
        piece_codec.SHORT = old

    return without_lists


def test_cut_is_the_fine_one():
    assert piece_codec.codec(MODEL).cut is piece_codec.WORDS


def test_long_texts():
    for text in ["a" * 20_000, "the " * 5_000, " " * 5_000, "\n" * 3_000, "é梦" * 3_000]:
        assert piece_codec.codec(MODEL).encode(text) == LIBRARY.encode(text)


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " ", "The  cat\nsat.", "The  cat\nsat.", "x" * 30_000, "a▁b \U0001f600"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "The  cat\nsat.")]


def test_table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    got = piece_codec.digests(piece_codec.encode_decode(docs, MODEL)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids) if ids else ""), True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert piece_codec.encode_decode(docs, MODEL).count() == 0


def test_a_wrong_word_is_reported(spark, monkeypatch):
    own = piece_codec.PieceCodec(MODEL)
    ids = own.encode_bytes("some words here")
    assert own.check(["some words here"], [ids], whole=True) == [True] and not own.wrong
    own.pieces["▁wrongly"] = (-1.0, 5)
    own.pieces["wrongly"] = (0.0, 6)
    own.pieces.update({"wr": (0.0, 7), "wro": (0.0, 8)})
    bad = own.encode_bytes("a wrongly cut")
    assert own.check(["a wrongly cut", "some words"], [bad, b""], whole=False) == [False, True]
