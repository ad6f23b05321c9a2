"""Plans against best fit on single pieces; packed documents against the library itself."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from obsframe.llm import packing

CASES = [(1, None), (2, ""), (3, "a b  c\n\n d"), (3, "a b  c\n\n d"), (None, "it's"), (4, "word  " * 900), (5, "x" * 3_000),
         (6, " " * 2000 + "y" + "\n" * 900), (7, "<|endoftext|> é漢😀﷐" * 200), (8, "tab\tand\x1c nbsp\xa0 x　 y\r\n z " * 90)]


def best_fit(lengths, size):
    """Sequences that best fit needs, longest pieces first, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else size) - length)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=15))
def test_plan_is_best_fit(histogram):
    size = 30
    entries = packing.plan(histogram, size)
    assert len(entries) <= 3 * size * 5
    used: dict[int, list] = {}
    for i, (length, rank, sequence, each, offset) in enumerate(entries):
        following = entries[i + 1] if i + 1 < len(entries) else (None,)
        until = following[1] if following[0] == length else histogram[length]
        for index in range(until - rank):
            used.setdefault(sequence + index // each, []).append((offset + index % each * length, length))
    for pieces in used.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= size
    assert len(used) == best_fit([n for n, count in histogram.items() for _ in range(count)], size)
    assert sum(len(p) for p in used.values()) == sum(histogram.values())


def wanted_pieces(pairs, size, plain=False):
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    library.encode_special_tokens = plain
    out = []
    for doc_id, text in pairs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at, number = 0, 0
        while at < len(ids):
            after = at + ((len(ids) - at) % size or size)
            out.append((doc_id, number, at, after - at, np.array(ids[at:after], "<u4").tobytes()))
            at, number = after, number + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk, size, plain", [(packing.CHUNK, 64, False), (50, 7, True), (50, 64, False)])
def test_documents(documents, chunk, size, plain):
    got = packing.pack(documents(CASES), size, chunk=chunk, plain=plain).collect()
    want = wanted_pieces(CASES, size, plain)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got), key=repr) == want
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= size and len(ends) == best_fit([w[3] for w in want], size)


def test_empty_table(documents):
    assert packing.pack(documents([])).count() == 0


def test_query(spark):
    import __spark_entry__
    folder = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["op12_best_fit_packing"](spark, folder).collect()
    pairs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*w[:4], zlib.crc32(w[4])) for w in wanted_pieces(pairs, 2048)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == want
    assert len({r.sequence_id for r in got}) == best_fit([w[3] for w in want], 2048)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
