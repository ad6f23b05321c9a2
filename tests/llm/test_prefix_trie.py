"""The trie against a plain one of Python dictionaries."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from obsframe.llm import prefix_trie as p

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, `a.b` string"


def plain(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - c % 5, [])[:h] + own[c][h:]
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(c)
            if depth:
                children[tuple(turns[:depth - 1])].add(tuple(turns[:depth]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, m in members.items()), key=repr)


def conversations(seed, count, words=3, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c * rng.choice([1, 1, 2]), turn, rng.choice(["user", "bot", None]), rng.choice(["ü" * k for k in range(words)] + [None])))
    return rows


ODD = [(7, None, None, None), (7, 1, "a", "x"), (7, 1, "a", "x"), (7, 1, "b", "y"), (None, 1, "a", "z"), (5, 0, "user", "hi"), (1000, 3, "u", "w" * 50_000)]


@pytest.mark.parametrize("fan, partitions", [(32, None), (2, 7), (3, 40)])
def test_trie(spark, fan, partitions):
    rows = conversations(1, 150) + conversations(2, 400, words=1, longest=4) + ODD
    data = spark.createDataFrame([(*r, "p", 1, "q") for r in rows], SCHEMA)
    got = p.conversation_trie(data, fan, partitions)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain(rows)


def test_runs(spark, monkeypatch):
    monkeypatch.setattr(p, "RUN", 7)
    rows = conversations(3, 120, words=2)
    got = p.conversation_trie(spark.createDataFrame([(*r, "p", 1, "q") for r in rows], SCHEMA), 4, 3)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("seed", range(40))
def test_merge_in_any_grouping(seed):
    rng = random.Random(seed)
    names = ["%032d" % i for i in range(3)]
    paths = sorted(("".join(rng.choice(names) for _ in range(rng.randrange(7))), c) for c in range(rng.randrange(1, 25)))
    make = lambda: [p.single(c, path, [len(path)] * (len(path) // 32)) for path, c in paths]
    want: list = []
    p.finish(p.merge(make(), want), want)
    got, pieces = [], make()
    while len(pieces) > 1:
        at = rng.randrange(len(pieces) - 1)
        size = rng.randrange(2, 5)
        pieces[at:at + size] = [p.merge(pieces[at:at + size], got)]
    p.finish(pieces[0], got)
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[0] for r in got}) == len(got)


def test_empty_table(spark):
    assert p.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    import __spark_entry__
    folder = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["op13_prefix_trie"](spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain(rows)
