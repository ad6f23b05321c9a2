"""Equality with the public library, and exact round trips."""
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from obsframe.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
PAIRS = bpe.Pairs(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)
TEXT = st.text(alphabet=st.sampled_from("ab1 '\n\t sSé.,漢😀 \x1c　‍"), max_size=300)


def ids(text):
    packed, = bpe.Encoder(RANKS, PAIRS).pack([PATTERN.findall(text)])
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=100, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=100)))
def test_pieces_and_merges(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_every_character_class():
    points = [c for c in range(1, 0x3200) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)}  " for c in points[first:first + 500])
        assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abxy漢", min_size=200, max_size=900))
def test_heap_and_rounds_agree(text):
    wanted = LIBRARY.encode_ordinary(text)
    assert bpe._merge_long(text.encode(), RANKS) == bpe.merge_many([text.encode()], PAIRS)[0].tolist() == wanted


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 40), st.integers(0, 20))
def test_stitching(text, size, overlap):
    parts = [(o, t, bpe.scan(t, PATTERN)) for o, t in bpe.chunks(text, size, overlap)]
    found = list(bpe.stitch(parts, PATTERN))
    assert "".join(t for t, _ in found) == text
    pieces = [t[a:b] for t, e in found for a, b in zip([0, *e[:-1]], e)]
    assert pieces == PATTERN.findall(text)


CASES = [(1, None), (2, ""), (3, "a b  c\n\n d"), (3, "a b  c\n\n d"), (None, "it's"), (4, "word  " * 5000),
         (5, "x" * 20_000), (6, " " * 9000 + "y" + "\n" * 3000), (7, "<|endoftext|> é漢😀" * 900)]


@pytest.mark.parametrize("size, overlap", [(bpe.CHUNK, bpe.OVERLAP), (700, 40)])
def test_digests(documents, rows, size, overlap):
    wanted = []
    for i, text in CASES:
        tokens = LIBRARY.encode_ordinary(text or "")
        wanted.append((i, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows(bpe.token_digests(documents(CASES), size=size, overlap=overlap)) == sorted(wanted, key=repr)


def test_columns_and_empty_table(documents):
    docs = documents(CASES)
    out = bpe.decode(bpe.encode(docs, name="score"), source="score", name="words")
    assert set(out.columns) == set(docs.columns) and out.count() == len(CASES)
    assert all(bytes(r.words) == (r.text or "").encode() for r in out.collect())
    assert bpe.token_digests(documents([])).count() == 0


def test_whole_table_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in bpe.token_digests(docs, size=4096, overlap=64).collect()}
    for r in docs.collect():
        tokens = LIBRARY.encode_ordinary(r.text or "")
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
