"""Overlaps against a comparison of every window on every diagonal."""
import itertools
import random
import re

import pytest

from obsframe.llm import decontaminate as dc


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")


def brute(docs, items):
    out = {}
    for item, text in items:
        b = words(text)
        if len(b) < dc.SPAN:
            continue
        size = dc.window(len(b))
        for doc, other in docs:
            a = words(other)
            for shift in range(-len(b), len(a)):
                equal = [1 if 0 <= j + shift < len(a) and a[j + shift] == b[j] else 0 for j in range(len(b))]
                inside = [0 <= j + shift < len(a) for j in range(len(b))]
                for s in range(len(b) - size + 1):
                    if all(inside[s:s + size]) and sum(equal[s:s + size]) >= size - dc.allowed(size):
                        out[doc, item] = max(out.get((doc, item), (0,))[0], sum(equal[s:s + size])), size
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


@pytest.mark.parametrize("size", range(dc.SHORTEST, dc.LONGEST + 1))
def test_masks_avoid_all_allowed_substitutions(size):
    places = [sum(1 << (at + o) for o in mask) for mask in dc.MASKS for at in range(size - mask[-1])]
    for bad in itertools.combinations(range(size), dc.allowed(size)):
        assert any(not p & sum(1 << b for b in bad) for p in places)


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def planted(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "漢字", "the", "the", "a"]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([7, 8, 9, 10, 13, 19, 20, 21, 45, 60])]
    docs = []
    for i, item in items:
        for changes in (0, 1, 2, 3, 4, 5, 8):
            copy = list(item)
            for place in draw.sample(range(len(copy)), min(changes, len(copy))):
                copy[place] = "changed"
            docs.append((len(docs), some(draw.randint(0, 12)) + copy[draw.randint(0, 3):] + some(draw.randint(0, 12))))
    join = lambda ws: "  ".join(w.upper() + "," for w in ws)
    return [(i, join(d)) for i, d in docs], [(i, " ".join(w)) for i, w in items]


def test_planted_passages(spark, documents, rows, monkeypatch):
    docs, items = planted()
    wanted = brute(docs, items)
    assert len(wanted) > 25
    assert rows(dc.overlaps(documents(docs), table(spark, items))) == wanted
    monkeypatch.setattr(dc, "BLOCK_WORDS", 50)
    assert rows(dc.overlaps(documents(docs), table(spark, items))) == wanted


def test_clean(spark, documents):
    docs, items = planted()
    docs += [(None, docs[43][1]), (None, "harmless"), (7, None), (8, ""), (9, "the " * 50_000), (docs[43][0], "same id")]
    kept = dc.clean(documents(docs), table(spark, items))
    assert kept.columns == documents(docs).columns
    dirty = {r[0] for r in brute(docs[:-6], items)}
    assert 43 in dirty
    wanted = [d for d in docs[:-6] if d[0] not in dirty] + docs[-5:]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(wanted, key=repr)


def test_odd_tables(spark, documents, rows):
    passage = " ".join(f"t{i}" for i in range(15))
    docs = documents([(1, passage), (1, passage), (None, passage), (2, None)])
    items = [(5, passage), (5, passage), (None, passage), (6, None), (7, "")]
    assert rows(dc.overlaps(docs, table(spark, items))) == sorted(
        [(d, i, 15, 15) for d in (1, None) for i in (5, None)], key=repr)
    assert dc.overlaps(documents([]), table(spark, items)).count() == 0
    assert dc.overlaps(docs, table(spark, [])).count() == 0
    assert dc.clean(docs, table(spark, [])).count() == 4
    assert dc.clean(documents([]), table(spark, items)).count() == 0


def test_one_word_repeated(spark, documents, rows):
    docs, items = [(1, "the " * 300), (2, "a " * 300)], [(1, "the " * 30)]
    assert rows(dc.overlaps(documents(docs), table(spark, items))) == [(1, 1, 20, 20)]


def test_no_python_in_the_plan(spark, documents):
    plan = dc.overlaps(documents([(1, "a")], extra=False), table(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_allowed_substitution_is_found(spark, documents, rows):
    """Items of 10 to 15 words, alone in a document, with each set of changes that is allowed."""
    items, docs, wanted = [], [], []
    for size in range(10, 16):
        words = [f"i{size}w{j}" for j in range(size)]
        items.append((size, " ".join(words)))
        for bad in itertools.combinations(range(size), dc.allowed(size)):
            wanted.append((len(docs), size, size - len(bad), size))
            docs.append((len(docs), " ".join("changed" if j in bad else w for j, w in enumerate(words))))
    assert rows(dc.overlaps(documents(docs, extra=False), table(spark, items))) == sorted(wanted, key=repr)
