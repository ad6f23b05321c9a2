"""Near duplicates by Order MinHash, verified by banded alignment.

Words are runs of letters and digits, in lower case. Texts with equal words are one text, so
copies never meet as pairs. The k-mers of a text are its windows of ``K`` words, each labelled with
its occurrence number. For each of ``SKETCHES`` permutations the ``PICKED`` smallest labelled k-mers are
taken and kept in the order they have in the text; their hash is a bucket. Texts in one
bucket are candidates. The three numbers follow from the recall wanted at the bound itself: of texts with a fifth of
their words changed at least 99 in 100 meet (checked in the tests for 25 to 200 words); whatever the places of the edits, such texts have
three fifths of their pairs of words in common.

A text of at most ``SHORT`` words has exact buckets in place of sketches: if the longer of two texts is cut
into one run of words more than edits are allowed, a run is left whole, and it lies in the shorter one at a place that the edits before and after
it can reach. A bucket is such a run with its number and the length of the longer text, so no link to a
short text is missed. Two texts are linked if the edit distance of their words is at most ``1 - SIMILARITY`` of
the longer one, found by a bit-parallel alignment inside the band that this bound allows. Before texts are fetched for it,
pairs that cannot be that close are ruled out by their lengths and by the counts of their words in ``BAG`` hashed
cells, of which an exchanged word changes two by one at most and any other edit one, with the length. Classes are the connected
components of the links; the smallest ``doc_id`` names a class.

Buckets of any size are worked off without pairing all of their members:

* First every member is compared with the smallest member of its bucket, once for all buckets they share.
* A bucket whose members are then all in one class is settled: a further link inside it changes no class.
* Of the others those of at most ``FEW`` members compare members of different classes.
* Larger ones are dealt out anew by rare words. Two texts with ``e`` edits at most between them have all but ``e`` words in common, so
  whatever the order in which words are ranked, the ``e + 1`` first ones of the two have one in common (a prefix filter).
  Words, numbered by occurrence, rank by how rarely the texts of such buckets have them, counted in a table of ``CELLS`` cells. Each
  such word is a new bucket, however many large ones a text was in, and few texts share it even where a passage is very common.
  Texts that met in no large bucket may meet in one of these, too. Two of its texts become a pair only if the words that
  follow their first common one are enough for the bound (its rank in either text tells), and if the parities of these words in ``PARITIES`` hashed
  cells, of which an edit changes two at most, differ no more than the edits allow. A text without another of like length and
  another class leaves its bucket. Texts that share one of the last ``EARLIER`` words before this one in either text meet in that word's
  bucket and are no pair here; the first common word has none before it, so every pair is made at least once.
* If one of those has more than ``LEADERS`` members still, the next ``LEADERS`` smallest lead, and members of other classes are compared with
  them; this is repeated, with the classes as they are by then, until no bucket holds an uncompared pair of different classes.

So no link between members of one bucket can be missing from the classes, whatever its size.

A text with fewer words than ``K`` is one k-mer; texts without words are equal. A
null text is empty. Null ids come last, so a class has a null name only if it has no other
id. Repeated rows are copies. An empty table gives an empty result. ``drop_near_duplicates``
keeps one row of each class, one with the smallest id, with its own columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.llm.columns import own, spare
from obsframe.llm.components import components, extend
from obsframe.llm.windows import Hasher, blocks
from obsframe.session import write_once

K = 2
SKETCHES = 64
PICKED = 3
SHORT = 24
SIMILARITY = 0.8
FEW = 24
LEADERS = 256
CELLS = 1 << 18
PART = 1 << 10
BAG = 128
PARITIES = 6144
SPREAD = 64
EARLIER = 32
SEED = 0x5DEECE66D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words."""
    plain = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        plain = _mix(plain + words[i:i + len(plain)] + np.uint64(i + 1))
    return plain


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the windows of ``k`` words with their occurrence numbers, in text order; ``words`` are word hashes."""
    if len(words) < k:
        words, k = np.concatenate([words, np.zeros(1, np.uint64)]), len(words) + 1
    plain = _runs(words, k)
    count = len(plain)
    order = np.argsort(plain, kind="stable")
    fresh = np.concatenate([[True], plain[order][1:] != plain[order][:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(count), 0))
    occurrence = np.empty(count, np.uint64)
    occurrence[order] = np.arange(count) - first
    return _mix(plain ^ _mix(occurrence + np.uint64(1)))


def sketches(words: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One bucket number per permutation: the smallest labelled k-mers, hashed in text order."""
    labelled = kmers(words)
    seeds = _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(SEED))
    together, out = max(1, 200_000 // len(labelled)), []
    for first in range(0, count, together):
        value = seeds[first:first + together]
        ranked = labelled[None, :] * (value[:, None] | np.uint64(1))
        rows, least = np.arange(len(value)), np.empty((min(picked, len(labelled)), len(value)), np.int64)
        for at in least:
            at[:] = ranked.argmin(axis=1)
            ranked[rows, at] = np.uint64(2**64 - 1)
        for at in np.sort(least, axis=0):
            value = _mix(value * np.uint64(31) + labelled[at])
        out.append(value)
    return np.concatenate(out)


_KNOWN: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}


def _places(size: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the starts of the runs that are exact buckets of a text of ``size`` words, and their names."""
    if size in _KNOWN:
        return _KNOWN[size]
    found = set()
    for longer in range(size, size * 5 // 4 + 2):
        edits, gap = allowed(longer), longer - size
        if gap > edits or edits == 0 or longer - edits > SHORT:
            continue
        cuts = [i * longer // (edits + 1) for i in range(edits + 2)]
        shifts = range(-((edits + gap) // 2), (edits - gap) // 2 + 1) if size <= SHORT else [0]
        for i, (start, end) in enumerate(pairwise(cuts)):
            found |= {(end - start, start + s, longer << 8 | i) for s in shifts if start + s >= 0 and end + s <= size}
        if size > SHORT:
            break
    lengths = sorted({f[0] for f in found})
    _KNOWN[size] = {n: tuple(np.array(x, np.uint64) for x in zip(*sorted(f[1:] for f in found if f[0] == n))) for n in lengths}
    return _KNOWN[size]


def buckets(words: np.ndarray) -> np.ndarray:
    """The bucket numbers of a text: exact ones to meet texts of at most ``SHORT`` words, and sketches to meet longer ones."""
    out = [_mix(_runs(words, n)[starts] ^ _mix(names)) for n, (starts, names) in _places(len(words)).items()] if len(words) <= 2 * SHORT else []
    if len(words) > SHORT:
        out.append(sketches(words))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of the words of each whole text."""
    hasher, found = Hasher(), [[] for _ in texts]
    for owners, parts in blocks(texts):
        block = hasher.block(parts)
        at, hashes = block.words()
        cuts = np.searchsorted(at, block.starts[1:])
        for owner, some in zip(owners, np.split(hashes, cuts)):
            found[owner].append(some)
    for rows in found:
        yield np.concatenate(rows)


def distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    Equal ends are cut off, and the number of items in common gives a first bound. Of the table of distances only the
    ``2 * most + 1`` diagonals that ``most`` edits can reach are kept. Their differences from row to row are bits of
    two numbers, and the band moves down one row with each column, so that its last diagonal keeps its bit until it meets the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(b))
    a, b = a[:len(a) - end], b[:len(b) - end]
    if not b:
        return len(a)
    if not most or len(a) - (Counter(a) & Counter(b)).total() > most:
        return None
    most = min(most, len(a))
    width = 2 * most + 1
    full, last, edge = (1 << width) - 1, 1 << width - 1, 1 << width - 2
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i + most
    rises, falls, value = full & -(1 << width - most - 1), 0, most
    for i, y in enumerate(b):
        match = places.get(y, 0) >> i & full
        flat = ((match & rises) + rises ^ rises | match | falls) & full   # no step along the diagonal
        right_up, right_down = falls | full & ~(flat | rises), flat & rises
        if i < len(a) - most:
            value += not flat & last
        else:
            value += bool(right_up & edge) - bool(right_down & edge)
            edge >>= 1
        rises, falls = right_down | full & ~(flat >> 1 | right_up), flat >> 1 & right_up
    return value if value <= most else None


def allowed(longer: int) -> int:
    """Edits between texts of which the longer has so many words."""
    return int(longer * (1 - SIMILARITY) + 1e-9)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _signs(base: DataFrame, texts: DataFrame) -> DataFrame:
    """text, buckets, size, bag: the buckets, number of words and counts of words of every distinct text."""
    def sketched(batches):
        for batch in batches:
            words = list(word_hashes(batch["plain"].tolist()))
            bags = [np.minimum(np.bincount((w % np.uint64(BAG)).astype(np.int64), minlength=BAG), 255).astype(np.uint8).tobytes() for w in words]
            yield pd.DataFrame({"digest": batch["digest"], "buckets": [buckets(w).view(np.int64) for w in words],
                                "size": [len(w) for w in words], "bag": bags})

    found = base.select("digest", "plain").mapInPandas(sketched, "digest string, buckets array<long>, size int, bag binary")
    once = found.groupBy("digest").agg(*(F.any_value(c).alias(c) for c in ("buckets", "size", "bag")))
    return once.join(texts, "digest").select("text", "buckets", "size", "bag")


def _bucket_rows(signs: DataFrame) -> DataFrame:
    return signs.select(F.explode("buckets").alias("bucket"), "text", "size")


def _alike(size: str, other: str) -> Column:
    """Whether texts of such lengths may be linked."""
    longer = F.greatest(size, other)
    return longer - F.least(size, other) <= F.floor(longer * (1 - SIMILARITY) + 1e-9)


def rare_first(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of those words, numbered by occurrence, of which a linked text has at least one among its own."""
    if not len(words):
        return words
    labelled = kmers(words, 1)
    order = np.lexsort((labelled, counts[words % np.uint64(CELLS)]))
    return labelled[order[:allowed(len(words)) + 1]]


def parities(words: np.ndarray) -> np.ndarray:
    """Whether each of ``PARITIES`` cells holds an odd number of the words, numbered by occurrence, as bits of whole numbers."""
    labelled = kmers(words, 1) if len(words) else words
    counts = np.bincount((labelled % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def _word_counts(texts: DataFrame) -> np.ndarray:
    """How often the texts have the words of each of ``CELLS`` hashed cells.

    A task adds up all of its texts and passes on a row for each ``PART`` cells, not one for each word it has seen.
    """
    def counted(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for found in word_hashes(batch["plain"].tolist()):
                np.add.at(cells, (found % np.uint64(CELLS)).astype(np.int64), 1)
        parts = cells.reshape(-1, PART)
        at = np.flatnonzero(parts.any(axis=1))
        if len(at):
            yield pd.DataFrame({"part": at, "n": list(parts[at])})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = 0, np.zeros(PART, np.int64)
        for batch in batches:
            part = batch["part"].iloc[0]
            total += np.stack(batch["n"].tolist()).sum(axis=0)
        yield pd.DataFrame({"part": [part], "n": [total]})

    counts, kind = np.zeros((CELLS // PART, PART), np.int64), "part long, n array<long>"
    for row in texts.select("plain").mapInPandas(counted, kind).groupBy("part").applyInPandas(added, kind).collect():
        counts[row["part"]] = row["n"]  # at most CELLS / PART rows
    return counts.reshape(-1)


def _by_rare_words(rows: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (text, size, label), one for each text, dealt to a bucket for each rare word, with the word's ``rank`` in the text;
    and the rare words and parities of each text.

    Long texts are dealt out in runs of ``SPREAD`` words, so that all tasks have as much to do.
    """
    texts = write_once(words.join(rows.select("text"), "text", "left_semi"), "dealt")
    shared = rows.sparkSession.sparkContext.broadcast(_word_counts(texts))

    def rare(batches):
        for batch in batches:
            found = list(word_hashes(batch["plain"].tolist()))
            yield pd.DataFrame({"text": batch["text"], "words": [rare_first(w, shared.value).view(np.int64) for w in found],
                                "parities": [parities(w) for w in found]})

    keys = write_once(texts.mapInPandas(rare, "text long, words array<long>, parities array<long>"), "keys")
    runs = rows.join(keys.where(F.size("words") > 0).select("text", "words"), "text").select(
        "text", "size", "label", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(SPREAD))).alias("first"))
    runs = runs.withColumn("words", F.slice("words", F.col("first") + 1, SPREAD)).repartition("text", "first")
    dealt = runs.select("text", "size", "label", "first", F.posexplode("words").alias("place", "bucket"))
    return dealt.select("bucket", "text", "size", "label", (F.col("first") + F.col("place")).alias("rank")), keys


def _met(dealt: DataFrame) -> DataFrame:
    """All columns, members: rows of buckets in which a text of another class may be of like length.

    Two such texts lie in one cell of a grid of lengths, or in one of the grid moved by half a cell.
    """
    step = F.log(F.greatest("size", F.lit(1))) / float(np.log(1 / SIMILARITY + 0.01))
    mixed = F.lit(False)
    for moved in (0, 1):
        cell = Window.partitionBy("bucket", F.floor((step + moved) / 2))
        mixed |= F.min("label").over(cell) < F.max("label").over(cell)
    kept = dealt.repartition("bucket").withColumn("mixed", mixed).where("mixed").drop("mixed")  # shuffled once for all windows
    return kept.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("bucket")))


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows dealt out, with the parities of the text and the rare words just ``before`` the one of the bucket."""
    before = F.slice("words", F.greatest(F.col("rank") + 1 - EARLIER, F.lit(1)), F.least("rank", F.lit(EARLIER)))
    return rows.join(keys, "text").withColumn("before", before).drop("words")


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both texts, named with ``_a`` and ``_b``."""
    for end in ("b", "a"):
        pairs = pairs.join(table.select(F.col("text").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def _close(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose counts of words allow a link."""
    def possible(batches):
        for batch in batches:
            if len(batch):
                longer = batch[["size_a", "size_b"]].max(axis=1).to_numpy()
                most = (longer * (1 - SIMILARITY) + 1e-9).astype(np.int64)
                one, other = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, BAG).astype(np.int64) for c in ("bag_a", "bag_b"))
                apart = np.abs(one - other).sum(axis=1)
                near = longer - batch[["size_a", "size_b"]].min(axis=1).to_numpy() + apart <= 2 * most
                yield batch.loc[near, ["a", "b"]]

    return _both(pairs, signs, "size", "bag").mapInPandas(possible, "a long, b long")


def _links(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose texts are similar."""
    def aligned(batches):
        for batch in batches:
            kept = []
            for a, b, one, other in batch[["a", "b", "plain_a", "plain_b"]].itertuples(index=False, name=None):
                first, second = one.split(), other.split()
                if distance(first, second, allowed(max(len(first), len(second)))) is not None:
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return _both(pairs, words, "plain").mapInPandas(aligned, "a long, b long")


def _leftover(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """All columns, label, members: rows of the buckets that hold several classes."""
    labelled = buckets.join(classes.select(F.col("node").alias("text"), "label"), "text", "left")
    return _mixed(labelled.select(*buckets.columns, F.coalesce("label", "text").alias("label")))


def _mixed(labelled: DataFrame) -> DataFrame:
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"))
    return labelled.join(mixed.where("low != high").select("bucket", "members"), "bucket")


def _pairs(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """(a, b) of members and leaders of a bucket that are in different classes and of like length.

    Rows with ``rank``, ``parities`` and ``before`` are held to what these say, too.
    """
    ahead = leaders.select("bucket", *(F.col(c).alias(f"{c}_a") for c in leaders.columns if c not in ("bucket", "members")))
    longer = F.greatest("size", "size_a")
    edits = F.floor(longer * (1 - SIMILARITY) + 1e-9)
    alike = (F.col("text_a") < F.col("text")) & (F.col("label") != F.col("label_a")) & _alike("size", "size_a")
    if "rank" in rows.columns:
        alike &= (F.least(F.col("size") - F.col("rank"), F.col("size_a") - F.col("rank_a")) >= longer - edits)
        odd = [F.bit_count(F.get("parities", F.lit(i)).bitwiseXOR(F.get("parities_a", F.lit(i)))) for i in range(PARITIES // 64)]
        alike &= (reduce(add, odd) + longer - F.least("size", "size_a") <= 2 * edits) & ~F.arrays_overlap("before", "before_a")
    return rows.join(ahead, "bucket").where(alike).select(F.col("text_a").alias("a"), F.col("text").alias("b")).distinct()


def _classes(base: DataFrame, texts: DataFrame) -> DataFrame:
    """node, label of the distinct texts that are linked to another."""
    signs = write_once(_signs(base, texts.select("digest", "text")), "sketches")
    rows = _bucket_rows(signs)
    led = rows.groupBy("bucket").agg(F.min(F.struct("text", "size")).alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = write_once(rows.join(led.select("bucket", "a"), "bucket").select(
        "bucket", "text", "size", F.col("a.text").alias("a"), F.col("a.size").alias("size_a")), "shared")
    pairs = shared.where("text != a").where(_alike("size", "size_a")).select("a", F.col("text").alias("b")).distinct()
    involved = texts.join(shared.select("text").distinct(), "text", "left_semi").select("digest", F.col("keep_id").alias("doc_id"), "text")
    words = write_once(base.join(involved, (base["digest"] == involved["digest"]) & base["doc_id"].eqNullSafe(involved["doc_id"])).groupBy(
        "text").agg(F.any_value("plain").alias("plain")), "words")
    classes = components(write_once(_links(_close(pairs, signs), words), "links"))
    left = write_once(_leftover(shared.where("text != a").select("bucket", "text", "size"), classes), "leftover")
    few, many = left.where(F.col("members") <= FEW), left.where(F.col("members") > FEW)
    dealt, keys = _by_rare_words(many.select("text", "size", "label").distinct(), words)
    dealt = write_once(_met(dealt), "rare")
    marked = _marked(dealt.where(F.col("members") <= LEADERS).drop("members"), keys).repartition("bucket")  # shuffled once for both sides
    pairs = _close(_pairs(few, few), signs).union(_pairs(marked, marked)).distinct()
    classes = extend(classes, write_once(_links(pairs, words), "links"))
    columns = ["bucket", "text", "size", "rank"]
    rest = write_once(_leftover(dealt.where(F.col("members") > LEADERS).select(columns), classes), "leftover")
    while not rest.isEmpty():
        place = Window.partitionBy("bucket").orderBy("text")
        leaders = rest.withColumn("place", F.row_number().over(place)).where(F.col("place") <= LEADERS).drop("place")
        pairs = _pairs(_marked(rest, keys), _marked(leaders, keys))
        classes = extend(classes, write_once(_links(pairs, words), "links"))
        past = leaders.groupBy("bucket").agg(F.max("text").alias("past"))
        rest = write_once(_leftover(rest.join(past, "bucket").where("text > past").select(columns), classes), "leftover")
    return classes


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest), and digests with the smallest id of their copies and their class."""
    plain = _plain(F.col("text"))
    base = docs.select("doc_id", plain.alias("plain")).withColumn("digest", F.md5(F.col("plain").cast("binary")))
    members = write_once(base.select("doc_id", "digest"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"))
    texts = members.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    texts = write_once(texts.select("digest", F.col("first.id").alias("keep_id"), "copies", F.monotonically_increasing_id().alias("text")), "texts")
    classes = _classes(base, texts)
    named = texts.join(classes.withColumnRenamed("node", "text"), "text", "left").withColumn("label", F.coalesce("label", "text"))
    order = F.struct(F.col("keep_id").isNull().alias("n"), F.col("keep_id").alias("id"), F.col("text").alias("text"))
    ends = named.groupBy("label").agg(F.min(order).alias("first"), F.sum("copies").alias("class_size"))
    joined = named.join(ends, "label").select("digest", F.col("first.id").alias("class_id"), "class_size",
                                              (F.col("text") == F.col("first.text")).alias("named"))
    return members, write_once(joined, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size: one row per row of ``docs``; rows of one class are near copies of each other."""
    members, classes = _grouped(docs)
    return members.join(classes, "digest").select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, one with the smallest id, with its own columns."""
    _, classes = _grouped(docs)
    digest, row = spare(docs, "_digest"), spare(docs, "_row")
    winners = classes.where("named").select(F.col("digest").alias("_winner"), F.col("class_id").alias("_id"))
    keyed = docs.withColumn(digest, F.md5(_plain(F.col("text")).cast("binary")))
    kept = keyed.join(winners, (keyed[digest] == winners["_winner"]) & keyed["doc_id"].eqNullSafe(winners["_id"]), "left_semi")
    order = Window.partitionBy(digest).orderBy(F.col("text"))
    return kept.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*own(docs))
