"""Alignment, sketches and classes against brute force."""
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsframe.llm import near_dup as nd
from obsframe.llm.components import components


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


WORDS = st.lists(st.sampled_from("abcd"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS, st.integers(0, 45))
def test_distance(a, b, most):
    wanted = plain_distance(a, b)
    assert nd.distance(a, b, most) == (wanted if wanted <= most else None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=60, max_size=300), st.lists(st.tuples(st.integers(0, 299), st.sampled_from("xyz")), max_size=30))
def test_distance_of_long_sequences(a, edits):
    b = list(a)
    for at, letter in edits:
        if at % 3 == 0:
            b.insert(at % len(b), letter)
        elif at % 3 == 1 and len(b) > 50:
            del b[at % len(b)]
        else:
            b[at % len(b)] = letter
    for most in (5, 40, 400):
        wanted = plain_distance(a, b)
        assert nd.distance(a, b, most) == (wanted if wanted <= most else None)


def test_sketches_depend_on_order_and_occurrence():
    words = np.arange(1, 200, dtype=np.uint64)
    same = nd.sketches(words)
    assert len(same) == nd.SKETCHES and (nd.sketches(words.copy()) == same).all()
    assert not (nd.sketches(np.concatenate([words[100:], words[:100]])) == same).all()
    repeated = np.ones(100, np.uint64)
    assert len(set(nd.kmers(repeated).tolist())) == 100 - nd.K + 1
    for few in ([], [3], [3, 4]):
        assert len(nd.sketches(np.array(few, np.uint64))) == nd.SKETCHES


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")


def brute(docs):
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    split = [words(t) for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            if plain_distance(split[i], split[j]) <= nd.allowed(max(len(split[i]), len(split[j]))):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted([(docs[i][0], name[find(i)], len(groups[find(i)])) for i in range(len(docs))], key=repr)


def corpus(seed=5, bases=12, copies=9):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    docs = []
    for base in range(bases):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(40, 90))]
        for copy in range(copies if base % 3 else 1):
            made = [draw.choice(vocabulary) if draw.random() < 0.012 * copy else w for w in text]
            if copy % 4 == 3:
                made.insert(7, "extra")
            docs.append((len(docs) * 7 % 1009, "  ".join(w.title() + "," * (copy % 2) for w in made)))
    return docs


def test_classes(documents, rows, monkeypatch):
    docs = corpus() + [(2000, None), (2001, ""), (2002, "."), (2003, "one two"), (2004, "One, two!"), (2005, "one two three")]
    wanted = brute(docs)
    assert len({w[1] for w in wanted}) < len(docs) - 20
    assert rows(nd.near_duplicates(documents(docs))) == wanted
    kept = nd.drop_near_duplicates(documents(docs))
    assert kept.columns == documents(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[1] for w in wanted})


@pytest.mark.parametrize("few", [1, 4, 24])
def test_mixed_buckets_are_worked_off(documents, rows, monkeypatch, few):
    """Every text in the same buckets: classes must still be those of all pairs."""
    monkeypatch.setattr(nd, "LEADERS", 2)
    monkeypatch.setattr(nd, "FEW", few)
    monkeypatch.setattr(nd, "_bucket_rows", lambda signs: signs.selectExpr("1L as bucket", "text", "size"))
    docs = corpus(seed=8, bases=7, copies=5)
    assert rows(nd.near_duplicates(documents(docs))) == brute(docs)


def test_odd_tables(documents, rows):
    text = " ".join(f"t{i}" for i in range(40))
    docs = [(5, text), (5, text), (None, text), (None, "other words here"), (None, "other words here"), (9, "w " * 30_000), (8, "w " * 29_999)]
    out = rows(nd.near_duplicates(documents(docs)))
    assert out == sorted([(5, 5, 3), (5, 5, 3), (None, 5, 3), (None, None, 2), (None, None, 2), (9, 8, 2), (8, 8, 2)], key=repr)
    kept = nd.drop_near_duplicates(documents(docs)).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [5, 8, None]
    assert nd.near_duplicates(documents([])).count() == nd.drop_near_duplicates(documents([])).count() == 0


def test_more_links_only_work_on_what_they_join(spark, monkeypatch):
    from obsframe.llm import components as c
    table = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (21, 22)]
    more = [(3, 10), (10, 2), (30, 31), (31, 40), (22, 50), (20, 22), (7, 8)]
    classes, whole, worked = c.components(table(first)), c.components, []
    monkeypatch.setattr(c, "components", lambda links: whole(links) if worked.append(links.where("a != b").count()) else whole(links))
    groups = lambda found: sorted(sorted(r[0]) for r in found.groupBy("label").agg({"node": "collect_list"}).select(
        "collect_list(node)").collect())
    got = c.extend(classes, table(more))
    assert groups(got) == [[1, 2, 3, 10, 11], [7, 8], [20, 21, 22, 50], [30, 31, 40]] == groups(whole(table(first + more)))
    assert worked == [len(more) - 1]
    assert groups(c.extend(classes, table(more).limit(0))) == groups(classes)


def test_rare_words_are_counted_in_few_rows(spark, monkeypatch):
    """A task passes on sums for parts of the cells, not a row for each word; tasks without texts pass on nothing."""
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(4000)}" for _ in range(300)) for _ in range(200)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "text long, plain string").repartition(4)
    wanted = np.zeros(nd.CELLS, np.int64)
    for found in nd.word_hashes(texts):
        np.add.at(wanted, (found % np.uint64(nd.CELLS)).astype(np.int64), 1)
    made, whole = [], type(table).mapInPandas

    def watched(frame, *args):
        made.append(whole(frame, *args))
        return made[-1]

    monkeypatch.setattr(type(table), "mapInPandas", watched)
    assert (nd._word_counts(table) == wanted).all()
    assert len(made) == 1 and made[0].count() <= 4 * nd.CELLS // nd.PART < np.count_nonzero(wanted)
    assert not nd._word_counts(table.where("text < 0")).any()
    assert nd._word_counts(table.where("text = 7")).sum() == 300


def test_texts_of_many_buckets_are_dealt_out_once(documents, rows, monkeypatch):
    """However many large buckets a text is in, it gets a row for each of its rare words, and classes stay whole."""
    draw, passage = random.Random(12), [f"p{i}" for i in range(40)]
    docs = [(i, " ".join(passage + [f"v{draw.randrange(60)}" for _ in range(15)])) for i in range(60)]
    docs += [(100 + i, " ".join(words(t)[:-2] + ["x", f"y{i}"])) for i, t in docs[:12]]
    monkeypatch.setattr(nd, "FEW", 2)
    dealt, whole = [], nd._by_rare_words

    def watched(*args):
        found = whole(*args)
        dealt.append(found[0])
        return found

    monkeypatch.setattr(nd, "_by_rare_words", watched)
    assert rows(nd.near_duplicates(documents(docs))) == brute(docs)
    per_text = [(r["size"], r["count"]) for r in dealt[0].groupBy("text", "size").count().collect()]
    assert len(per_text) > 30
    assert all(n == nd.allowed(size) + 1 for size, n in per_text)


def test_texts_stay_with_others_of_like_length_and_another_class(spark):
    draw = random.Random(4)
    table = [(draw.randrange(40), i, draw.randrange(1, 400), draw.randrange(3) if i % 2 else i, 0) for i in range(400)]
    met = nd._met(spark.createDataFrame(table, "bucket long, text long, size int, label long, rank int")).collect()
    kept = {r["text"] for r in met}
    for one in table:
        mates = [x for x in table if x[0] == one[0] and x[3] != one[3]]
        if any(max(x[2], one[2]) - min(x[2], one[2]) <= nd.allowed(max(x[2], one[2])) for x in mates):
            assert one[1] in kept
        elif not any(max(x[2], one[2]) <= 1.6 * min(x[2], one[2]) for x in mates):
            assert one[1] not in kept
    assert all(r["members"] == sum(x["bucket"] == r["bucket"] for x in met) for r in met)


@pytest.mark.parametrize("earlier", [1, 4, 32])
def test_pairs_of_many_common_words_are_made_once(spark, monkeypatch, earlier):
    """Texts that share many rare words meet in the bucket of the first; the fewer words are looked back at, the more often again."""
    monkeypatch.setattr(nd, "EARLIER", earlier)
    draw = random.Random(7)
    prefixes = {i: sorted(draw.sample(range(60), 20)) for i in range(30)}
    table = [(w, i, 90, i, rank) for i, found in prefixes.items() for rank, w in enumerate(found)]
    none = [0] * (nd.PARITIES // 64)
    rows = spark.createDataFrame(table, "bucket long, text long, size int, label long, rank int")
    keys = spark.createDataFrame([(i, found, none) for i, found in prefixes.items()], "text long, words array<long>, parities array<long>")
    marked = nd._marked(rows, keys)
    wanted = {(i, j) for i in prefixes for j in prefixes if i < j
              if any(max(prefixes[i].index(w), prefixes[j].index(w)) <= nd.allowed(90) for w in set(prefixes[i]) & set(prefixes[j]))}
    made, whole = [], type(rows).distinct
    monkeypatch.setattr(type(rows), "distinct", lambda frame: whole(frame) if made.append(frame.count()) is None else None)
    found = {(r["a"], r["b"]) for r in nd._pairs(marked, marked).collect()}
    assert found == wanted
    assert made[0] == len(wanted) if earlier == 32 else made[0] > len(wanted)


def test_numbered_words_count_in_parities():
    once, thrice = (np.array([7] * n + [9], np.uint64) * np.uint64(977) for n in (1, 3))
    assert sum((int(x) & (2**64 - 1)).bit_count() for x in nd.parities(once) ^ nd.parities(thrice)) == 2
    assert not nd.parities(np.zeros(0, np.uint64)).any()


def test_components(spark):
    draw = random.Random(2)
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    wild = [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)]
    links = path + star + wild
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {n: n for e in links for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[find(a)] = find(b)
    real = [n for n in parent if any(n in e and e[0] != e[1] for e in links)]
    assert set(found) == set(real)
    assert len({found[n] for n in real}) == len({find(n) for n in real})
    assert all(found[a] == found[b] for a, b in links if a != b)


def test_recall_on_edited_texts():
    """Texts with a tenth of their words changed share a bucket nearly always."""
    draw, met, n = random.Random(4), 0, 200
    for _ in range(n):
        a = np.array([draw.getrandbits(60) for _ in range(200)], np.uint64)
        b = a.copy()
        for at in draw.sample(range(200), 20):
            b[at] = draw.getrandbits(60)
        met += bool((nd.sketches(a) == nd.sketches(b)).any())
    assert met / n >= 0.95


@pytest.mark.parametrize("size", [25, 40, 200])
@pytest.mark.parametrize("share", [0.15, 0.2])
def test_recall_up_to_the_bound(size, share):
    """Texts with as many words changed, or taken out and put in, as a link allows share a bucket nearly always."""
    draw, met, n = random.Random(size), 0, 300
    for i in range(n):
        a = [draw.getrandbits(60) for _ in range(size)]
        b = list(a)
        edits = int(size * share + 1e-9)
        for j, at in enumerate(draw.sample(range(size), edits)):
            if i % 2 or j == edits - 1 and edits % 2:
                b[at] = draw.getrandbits(60)
            elif j % 2:
                b.insert(draw.randrange(len(b) + 1), draw.getrandbits(60))
            else:
                del b[draw.randrange(len(b))]
        met += bool(set(nd.buckets(np.array(a, np.uint64))) & set(nd.buckets(np.array(b, np.uint64))))
    assert met / n >= 0.99


def test_short_texts_always_meet():
    """Every pair within the bound of which one text is short shares a bucket, wherever the edits are."""
    draw, linked = random.Random(6), 0
    for _ in range(6000):
        a = [draw.randrange(1, 7) for _ in range(draw.randint(4, 31))]
        b = list(a)
        for _ in range(draw.randint(0, nd.allowed(len(a)))):
            at, kind = draw.randrange(len(b)), draw.randrange(3)
            b[at:at + (kind != 1)] = [draw.randrange(1, 7)] * (kind != 2)
        if a != b and min(len(a), len(b)) <= nd.SHORT and nd.distance(a, b, nd.allowed(max(len(a), len(b)))) is not None:
            linked += 1
            assert set(nd.buckets(np.array(a, np.uint64))) & set(nd.buckets(np.array(b, np.uint64))), (a, b)
    assert linked > 2500


def test_classes_of_short_texts(documents, rows):
    draw, docs = random.Random(9), []
    for base in range(30):
        text = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(5, 24))]
        docs.append((len(docs), " ".join(text)))
        for at in draw.sample(range(len(text)), nd.allowed(len(text))):
            text[at] = f"x{draw.randrange(5000)}"
        docs.append((len(docs), " ".join(text)))
    wanted = brute(docs)
    assert len({w[1] for w in wanted}) == 30
    assert rows(nd.near_duplicates(documents(docs))) == wanted


def test_linked_texts_share_a_rare_word():
    draw = random.Random(6)
    counts = np.array([draw.randrange(50) for _ in range(nd.CELLS)])
    for _ in range(400):
        size = draw.randrange(5, 60)
        a = [draw.randrange(12) for _ in range(size)]
        b = list(a)
        for _ in range(draw.randrange(nd.allowed(size) + 1)):
            at = draw.randrange(len(b))
            b[at:at + 1] = draw.choice([[], [draw.randrange(12)], [draw.randrange(12), b[at]]])
        if plain_distance(a, b) <= nd.allowed(max(len(a), len(b))):
            one, other = (nd.rare_first(np.array(x, np.uint64) * np.uint64(977), counts) for x in (a, b))
            assert set(one.tolist()) & set(other.tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=120), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 200), st.integers(0, 80)), max_size=30),
       st.integers(0, 5))
def test_no_link_fails_rank_or_parities(a, edits, seed):
    """Texts within the allowed edits share a word among their rare ones, at ranks and with parities that the join accepts."""
    b = list(a)
    for kind, at, value in edits:
        if kind == 0 and b:
            b[at % len(b)] = value
        elif kind == 1:
            b.insert(at % (len(b) + 1), value)
        elif len(b) > 1:
            del b[at % len(b)]
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    most = nd.allowed(longer)
    if nd.distance(a, b, most) is None:
        return
    one, other = (nd._mix(np.array(x, np.uint64) + np.uint64(1)) for x in (a, b))
    counts = np.random.default_rng(seed).integers(1, 50, nd.CELLS)
    first, second = (nd.rare_first(w, counts).tolist() for w in (one, other))
    met = [(i, second.index(x)) for i, x in enumerate(first) if x in second]
    assert any(min(len(a) - i, len(b) - j) >= longer - most for i, j in met)
    apart = sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) & (2**64 - 1)).bit_count()
                for x, y in zip(nd.parities(one).tolist(), nd.parities(other).tolist()))
    assert apart + longer - shorter <= 2 * most
