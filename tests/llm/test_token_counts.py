"""Counts against the public library with the same pieces as a unigram model."""
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from obsframe.llm import token_counts as tc

PATH = public_tokenizers.path(tc.MODEL)
PIECES = tc.read_pieces(PATH)
COUNTER = tc.Counter(PIECES)


def unigram(change=lambda score: score):
    with open(PATH, "rb") as data:
        model = proto.ModelProto.FromString(data.read())
    kept = [p for p in model.pieces if p.type != 1 or p.piece in PIECES]
    del model.pieces[:]
    for piece in kept:
        piece.score = change(PIECES[piece.piece]) if piece.type == 1 else piece.score
        model.pieces.append(piece)
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


LIBRARY = unigram()


def count(text, counter=COUNTER):
    (n, score), = counter.count([tc.words(text)])
    return n


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="theandig ▁\n漢é😀", max_size=120)))
def test_counts(text):
    if "\x00" not in text and "▁" not in text:
        assert count(text) == len(LIBRARY.encode(text))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="theandig s", max_size=60))
def test_ties(text):
    """With few different scores nearly every choice is a tie."""
    assert count(text, TIED) == len(TIED_LIBRARY.encode(text))


TIED = tc.Counter({p: -float(int(-s) // 16000) for p, s in PIECES.items()})
TIED_LIBRARY = unigram(lambda s: -float(int(-s) // 16000))


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = tc.count_tokens(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.token_score > -2 ** 24:
            assert r.n_tokens == len(LIBRARY.encode(r.text))
    assert sum(r.token_score > -2 ** 24 for r in rows) > 100


def test_odd_tables(documents):
    docs = documents([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "x" * 50_000), (5, "a b " * 50_000), (6, " ")])
    out = {r.doc_id: r for r in tc.count_tokens(docs.withColumnRenamed("kept", "n_tokens")).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0 and out[3].n_tokens == out[None].n_tokens == 2 and out[6].n_tokens == 2
    assert out[4]["a.b"] == {"k": "v"} and out[5].n_tokens >= 100_000
    assert tc.count_tokens(documents([])).count() == 0


def test_pieces_across_blanks_are_refused(monkeypatch):
    monkeypatch.setattr(tc, "NO_SCORE", -1e12)
    with pytest.raises(ValueError):
        tc.read_pieces(PATH)
