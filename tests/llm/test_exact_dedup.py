import hashlib
import re
from collections import defaultdict

import pytest

from obsframe.llm import exact_dedup

LONG = "word " * 200_000
CASES = [(5, "a  b"), (3, "a\tb"), (9, "a \n b"), (4, None), (2, ""), (8, " "), (7, LONG), (6, LONG), (1, "other"),
         (10, "a b"), (11, "x\x0b\x0cy"), (12, "x y")]


def brute(pairs):
    groups = defaultdict(list)
    for i, text in pairs:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(i)
    return sorted((i, min(ids), len(ids), i == min(ids), digest) for digest, ids in groups.items() for i in ids)


def test_groups(documents, rows):
    assert rows(exact_dedup.duplicate_groups(documents(CASES))) == sorted(brute(CASES), key=repr)


def test_frequent_texts(documents, rows):
    pairs = [(i, f"hot {i % 2}" if i % 3 else f"own {i % 700}") for i in range(3000)]
    docs = documents(pairs).repartition(16)
    assert rows(exact_dedup.duplicate_groups(docs)) == sorted(brute(pairs), key=repr)
    kept = {b[1] for b in brute(pairs)}
    assert {r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()} == kept


def test_sketch_holds_every_frequent_digest(documents):
    docs = documents([(i, f"t{i % 5}" if i % 2 else f"u{i}") for i in range(20_000)], extra=False).repartition(8)
    found = {r.text for r in exact_dedup.frequent(docs, "text", tracked=64, candidates=16).collect()}
    assert {f"t{k}" for k in range(5)} <= found


def test_whole_rows_stay(documents):
    docs = documents(CASES)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {r.doc_id: r["a.b"] for r in kept.collect()} == {i: {"k": "v"} for i in {b[1] for b in brute(CASES)}}


def test_repeated_rows_and_null_ids(documents, rows):
    pairs = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    out = rows(exact_dedup.duplicate_groups(documents(pairs)), "doc_id", "keep_id", "group_size", "kept")
    assert sorted(out, key=repr) == sorted([(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False),
                                            (None, None, 2, True), (None, None, 2, False)], key=repr)
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_duplicates(documents(pairs)).collect() if r.doc_id) == [(1, "a")]
    assert exact_dedup.drop_duplicates(documents(pairs)).count() == 2


@pytest.mark.parametrize("function", [exact_dedup.duplicate_groups, exact_dedup.drop_duplicates])
def test_empty(documents, function):
    assert function(documents([])).count() == 0
