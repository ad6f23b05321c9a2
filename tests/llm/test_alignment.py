"""Alignment against a plain one, token by token, over whole texts encoded by the libraries themselves."""
import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from obsframe.llm import alignment, units

LEFT = units.ByteTokens(public_tokenizers.path(alignment.FIRST))
RIGHT = units.PieceTokens(public_tokenizers.path(alignment.SECOND))
BYTES = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
BYTES.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups_of(text):
    if not text:
        return []
    sides = []
    for ids, tokens in ((BYTES.encode(" " + text, add_special_tokens=False).ids, LEFT.tokens), (PIECES.encode(text), RIGHT.tokens)):
        if b"".join(tokens[i] for i in ids) != (" " + text).encode():
            return []
        sides.append((ids, np.cumsum([len(tokens[i]) for i in ids]).tolist()))
    shared = sorted(set(sides[0][1]) & set(sides[1][1]))
    out = [([], []) for _ in shared]
    for side, (ids, ends) in enumerate(sides):
        for i, end in zip(ids, ends):
            out[bisect_left(shared, end)][side].append(i)
    return out


def plain(pairs):
    found = [(doc_id, groups_of(text)) for doc_id, text in pairs]
    linked = [Counter((a, b) for left, right in groups for a in left for b in right) for _, groups in found]
    counts = Counter(pair for links in linked for pair in links)
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    rows = []
    for (doc_id, groups), links in zip(found, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                     sum(n for pair, n in links.items() if counts[pair] == highest[pair[0]]),
                     sum(n * counts[pair] for pair, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(rows, key=repr)


CASES = [(1, None), (2, ""), (3, "a b  c\n\n d"), (3, "a b  c\n\n d"), (None, "it's"), (4, "word  " * 900), (5, "x" * 1500), (5, "ab1" * 700),
         (6, " " * 300 + "y" + "\n" * 90), (7, "<|endoftext|> é漢😀﷐" * 60), (8, "tab\tand\x1c nbsp\xa0 x　 y\r\n z);\r\n" * 40),
         (9, "under ▁ mark"), (10, " "), (11, "\n"), (12, "a\x00b ‍.,'ve ﬁ ½①"), (13, "漢字かな交じり文" * 80), (14, "the cat sat " * 300)]


@pytest.mark.parametrize("chunk, size, fan", [(alignment.CHUNK, alignment.RANGE, alignment.FAN), (40, 16, 3), (10, 9, 2)])
def test_rows(documents, chunk, size, fan):
    got = alignment.align(documents(CASES), chunk=chunk, size=size, fan=fan)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain(CASES)
    for row in got.collect():
        assert row.groups_sha256 == (hashlib.sha256(row.groups.encode()).hexdigest() if row.groups else "")


def test_empty_table(documents):
    assert alignment.align(documents([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=25), st.lists(st.integers(0, 60), max_size=6), st.randoms(use_true_random=False))
def test_fragments_compose_in_any_order(a_sizes, cuts, rng):
    total = sum(a_sizes)
    a_ends = np.cumsum(a_sizes)
    b_ends = np.array(sorted({total, *(rng.randrange(1, total + 1) for _ in range(len(a_sizes)))}))
    a, b = np.arange(len(a_ends)), np.arange(len(b_ends)) + 100
    edges = sorted({0, total, *(min(c, total) for c in cuts)})
    parts, groups = [], []
    for low, high in zip(edges, edges[1:]):
        (i, j), (k, m) = (np.searchsorted(e, [low, high], "right") for e in (a_ends, b_ends))
        found, inner = alignment.fragment(a[i:j], a_ends[i:j], b[k:m], b_ends[k:m])
        parts.append(found)
        if inner is not None:
            for g, end in enumerate(inner.ends.tolist()):
                groups.append((end, inner.a[inner.a_group == g].tolist(), inner.b[inner.b_group == g].tolist()))
    while len(parts) > 1:
        at = rng.randrange(len(parts) - 1)
        parts[at], closed = alignment.compose(parts[at], parts.pop(at + 1))
        if closed:
            groups.append((closed[0], closed[1].tolist(), closed[2].tolist()))
    closed, first, pa, pb, sa, sb = parts[0]
    assert closed and not len(sa) and not len(sb)
    groups.append((first, pa.tolist(), pb.tolist()))
    want = alignment.Groups(a, a_ends, b, b_ends)
    assert sorted(groups) == [(end, want.a[want.a_group == g].tolist(), want.b[want.b_group == g].tolist()) for g, end in enumerate(want.ends.tolist())]
    pairs, times, _ = want.links()
    assert Counter(dict(reduce(lambda c, p: c.update({p[0]: p[1]}) or c, zip(pairs.tolist(), times.tolist()), Counter()))) == Counter(
        x << 32 | y for _, left, right in groups for x in left for y in right)


def test_large_groups_count_equal_ids_first():
    a, b = np.arange(300) % 3, np.arange(200) % 2
    found = alignment.Groups(a, np.append(np.arange(1, 300), 100_000), b, np.append(np.arange(500, 699), 100_000))
    pairs, times, starts = found.links()
    assert starts.tolist() == [0, 6] and sorted(zip(pairs.tolist(), times.tolist())) == [(x << 32 | y, 10_000) for x in range(3) for y in range(2)]


def test_query(spark):
    import __spark_entry__
    folder = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["op11_alignment"](spark, folder).collect()
    pairs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == plain(pairs)
