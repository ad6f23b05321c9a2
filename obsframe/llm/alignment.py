"""Two tokenizers' tokens of one text, aligned by their byte ranges.

Tokens of ``A`` (byte-level) and ``B`` (pieces) cover the same bytes: a blank and the text. Where a token of both ends, a
group closes. Every token of ``A`` in a group is linked to every token of ``B`` in it; a pair of ids counts the documents in
which it is linked somewhere.

A byte range of a text, seen alone, is a fragment: tokens up to its first shared end (the open prefix, whose group began
further left), closed groups, and tokens after its last shared end (the open suffix). A range without a shared end is open as
a whole. Two neighbouring fragments make one: the left one's suffix and the right one's prefix close a group. This is associative, so the
fragments of a very long text are made by different tasks and reduced as a tree, ``FAN`` at a time. Groups that are closed leave
the fragment at once, so what goes up the tree is open tokens alone.

Texts of at most ``CHUNK`` characters are single fragments, worked through in blocks: each different unit (see ``units``) of a block is
encoded and aligned once. A block holds each id pair once, with the number of its documents. Those rows, not the documents, are
summed over the corpus and joined with the sums, and each block gets back the counts of its own pairs.

Nulls, empty texts and texts whose tokens of ``A`` or ``B`` do not give back their bytes have no tokens and only zeros. Rows
are aligned one by one: null or repeated ids make no difference, each row counts as a document. A link that ties for the highest count of its ``A`` id is a best one
too. Extra columns are not used. An empty table gives an empty result. A run of very many bytes without a blank or line
feed between is encoded by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm import units
from obsframe.session import write_once

CHUNK = 1 << 16      # characters of a text that one task encodes, up to the next unit
RANGE = 1 << 14      # bytes of a leaf
FAN = 32             # fragments that are reduced at a time
BLOCK = 3_000_000    # characters of a block
LINKS = 500_000      # links of texts that are counted at once
PAIRS = 50_000       # id pairs that leave a block at once
GROUP = 16 << 20     # bytes that a writer of blocks holds
MANY = 4096          # links of a group beyond which equal ids are counted first
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"           # fixed value: the character that stands for a blank in pieces

TOTALS = ("n_a", "n_b", "n_groups", "n_links")


class Groups:
    """Closed groups of the tokens of some units: ids and ends of both sides, ends counted from the first unit's start."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray):
        self.a, self.b = a, b
        a_shared, b_shared = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        self.ends = a_ends[a_shared]
        self.a_group = np.cumsum(a_shared) - a_shared
        self.b_group = np.cumsum(b_shared) - b_shared
        count = len(self.ends)
        self.n_a, self.n_b = np.bincount(self.a_group, minlength=count), np.bincount(self.b_group, minlength=count)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs ``a << 32 | b``, how often each is meant, and where each group's pairs start."""
        sizes = self.n_a * self.n_b
        large, starts = {}, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        a_starts, b_starts = (np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]) for n in (self.n_a, self.n_b))
        for group in np.flatnonzero(sizes > MANY).tolist():
            ids, times = zip(*(np.unique(side[s[group]:s[group + 1]], return_counts=True)
                               for side, s in ((self.a, a_starts), (self.b, b_starts))))
            large[group] = (ids[0][:, None] << 32 | ids[1][None, :]).ravel(), np.outer(*times).ravel()
        small = np.ones(len(sizes), bool)
        if large:
            small[list(large)] = False
            sizes = sizes.copy()
            sizes[list(large)] = [len(pairs) for pairs, _ in large.values()]
            starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        pairs, times = np.empty(starts[-1], np.int64), np.ones(starts[-1], np.int64)
        mine = small[self.a_group]
        a, group = self.a[mine], self.a_group[mine]
        repeats = self.n_b[group]
        done = np.cumsum(repeats) - repeats
        order = np.arange(len(self.a))[mine] - a_starts[group]
        step = np.arange(repeats.sum())
        pairs[np.repeat(starts[group] + order * repeats - done, repeats) + step] = (
            np.repeat(a << 32, repeats) | self.b[np.repeat(b_starts[group] - done, repeats) + step])
        for number, (ids, counts) in large.items():
            pairs[starts[number]:starts[number + 1]], times[starts[number]:starts[number + 1]] = ids, counts
        return pairs, times, starts

    def texts(self, names: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """The written groups as one string for each token, a separator behind each, and where each group's strings start."""
        kind = np.concatenate([2 * self.a_group, 2 * self.b_group + 1])
        order = np.argsort(kind, kind="stable")
        ids, kind = np.concatenate([self.a, self.b])[order], kind[order]
        ahead = np.append(kind[1:], -1)
        behind = np.where(ahead == kind, 0, np.where(ahead >> 1 == kind >> 1, 1, 2))
        tables = [names[k] for k in range(3)]
        out = [tables[s][i] for s, i in zip(behind.tolist(), ids.tolist())]
        return out, np.concatenate([np.zeros(1, np.int64), np.cumsum(self.n_a + self.n_b)])


def _names(size: int) -> list[list[str]]:
    """Ids up to ``size`` with the separators within a side, between the sides, and behind a group."""
    return [[f"{i}{s}" for i in range(size)] for s in ",|;"]


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring starts."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return sums[starts[1:]] - sums[starts[:-1]]


SHORT = ("block long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, "
         "a int, b int, place int, documents long")


def _short(docs: DataFrame, first: str, second: str, written: bool) -> DataFrame:
    """Rows of short texts and rows of id pairs, both by block.

    A text's ``pairs`` are places in its block's list of pairs, each less the one before, and ``times`` their numbers of links, in
    four bytes each where they fit.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, {SHORT}" + (", groups string" if written else "")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = units.ByteTokens(first), units.PieceTokens(second)
        names = _names(max(len(left.tokens), len(right.tokens)))
        for number, block in enumerate(units.blocks(batches, "text", BLOCK)):
            yield from _rows(block, left, right, names, TaskContext.get().partitionId() << 32 | number, written)

    return docs.mapInArrow(aligned, fields)


def _rows(block: pa.RecordBatch, left, right, names, number: int, written: bool) -> Iterator[pa.RecordBatch]:
    parts = units.Units(block.column("text"))
    (a, a_wrong), (b, b_wrong) = units.encode(parts, left), units.encode(parts, right)
    wrong = a_wrong | b_wrong
    if wrong.any():  # such a unit has no tokens on either side, and its texts none at all
        a, b = _without(a, wrong), _without(b, wrong)
    a_ends, b_ends = np.cumsum(left.lengths[a.values]), np.cumsum(right.lengths[b.values])
    found = Groups(a.values, a_ends, b.values, b_ends)
    unit_ends = np.concatenate([np.zeros(1, np.int64), a_ends])[a.starts[1:]]
    groups = np.searchsorted(found.ends, np.concatenate([np.zeros(1, np.int64), unit_ends]), "right")

    strings, string_starts = found.texts(names)
    bounds = string_starts[groups].tolist()
    spelled = ["".join(strings[i:j]) for i, j in pairwise(bounds)]
    links, times, link_starts = found.links()
    known, places = np.unique(links, return_inverse=True)
    by_unit = units.Rows(places, link_starts[groups])

    counts = {"n_a": a.sizes(), "n_b": b.sizes(), "n_groups": np.diff(groups), "n_links": _segments(times, link_starts[groups])}
    totals = {name: _segments(of[parts.codes], parts.offsets) for name, of in counts.items()}
    bad = _segments(wrong[parts.codes].astype(np.int64), parts.offsets) > 0
    for name in totals:
        totals[name][bad] = 0

    documents = np.zeros(len(known), np.int64)
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(by_unit.sizes()[parts.codes])])[parts.offsets]
    made = None
    for low, high in units.slices(upto, LINKS):
        places, numbers, cut, seen = _linked(parts, by_unit, times, bad, low, high, len(known))
        documents += seen
        wide = "<i8" if len(numbers) and numbers.max() >= 1 << 31 else "<i4"
        packed, weights = places.astype("<i4").tobytes(), numbers.astype(wide).tobytes()
        size = np.dtype(wide).itemsize
        texts = ["" if bad[i] else "".join([spelled[c] for c in parts.codes[parts.offsets[i]:parts.offsets[i + 1]].tolist()])[:-1] for i in range(low, high)]
        columns = {"doc_id": block.column("doc_id").slice(low, high - low), "block": np.full(high - low, number), "row": np.arange(low, high),
                   **{name: of[low:high] for name, of in totals.items()},
                   "groups_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string()),
                   "pairs": pa.array([packed[4 * i:4 * j] for i, j in pairwise(cut)], pa.binary()),
                   "times": pa.array([weights[size * i:size * j] for i, j in pairwise(cut)], pa.binary()),
                   **{name: pa.nulls(high - low, pa.int32()) for name in ("a", "b", "place")}, "documents": pa.nulls(high - low, pa.int64())}
        if written:
            columns["groups"] = pa.array(texts, pa.string())
        made = pa.RecordBatch.from_pydict(columns)
        yield made
    for low in range(0, len(known), PAIRS):
        some = known[low:low + PAIRS]
        own = {"block": np.full(len(some), number), "a": some >> 32, "b": some & 0xFFFFFFFF, "place": np.arange(low, low + len(some)),
               "documents": documents[low:low + PAIRS]}
        yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(some), f.type) for f in made.schema],
                                         schema=made.schema)


def _linked(parts: units.Units, by_unit: units.Rows, times: np.ndarray, bad: np.ndarray, low: int, high: int,
            known: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Of the texts from ``low`` to ``high``: their pairs in order, each less the one before, the numbers of links, where
    each text's pairs start, and in how many texts each pair is."""
    first = parts.offsets[low]
    at, starts = by_unit.take(parts.codes[first:parts.offsets[high]])
    rows = np.repeat(np.arange(high - low), np.diff(starts[parts.offsets[low:high + 1] - first]))
    keys = rows * max(1, known) + by_unit.values[at]
    if bad[low:high].any():
        keep = ~bad[low:high][rows]
        keys, at = keys[keep], at[keep]
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], times[at[order]]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    row, place = np.divmod(keys[heads], max(1, known))
    weights = np.add.reduceat(weights, heads) if len(heads) else weights
    cut = np.searchsorted(row, np.arange(high - low + 1))
    steps = np.diff(place, prepend=0)
    opens = cut[:-1][np.diff(cut) > 0]
    steps[opens] = place[opens]
    return steps, weights, cut.tolist(), np.bincount(place, minlength=known)


def _without(rows: units.Rows, wrong: np.ndarray) -> units.Rows:
    sizes = np.where(wrong, 0, rows.sizes())
    return units.Rows(rows.values[np.repeat(~wrong, rows.sizes())], np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))


# Fragments: (closed, first shared end, prefix of a, prefix of b, suffix of a, suffix of b). An open one has its tokens in the prefix.

def fragment(a, a_ends, b, b_ends) -> tuple[tuple, Groups | None]:
    """The fragment of neighbouring tokens, and its closed groups if there are any."""
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    none = np.zeros(0, np.int64)
    if not len(shared):
        return (False, 0, a, b, none, none), None
    (a1, a2), (b1, b2) = (np.searchsorted(ends, shared[[0, -1]], "right") for ends in (a_ends, b_ends))
    inner = Groups(a[a1:a2], a_ends[a1:a2], b[b1:b2], b_ends[b1:b2]) if len(shared) > 1 else None
    return (True, int(shared[0]), a[:a1], b[:b1], a[a2:], b[b2:]), inner


def compose(left: tuple, right: tuple) -> tuple[tuple, tuple | None]:
    """Two neighbouring fragments as one, and the group (end, a, b) that closes between them, if one does."""
    closed, first, pa_, pb_, sa, sb = left
    also, second, qa, qb, ta, tb = right
    join = np.concatenate
    if not closed:
        return (also, second, join([pa_, qa]), join([pb_, qb]), ta, tb), None
    if not also:
        return (True, first, pa_, pb_, join([sa, qa]), join([sb, qb])), None
    return (True, first, pa_, pb_, ta, tb), (second, join([sa, qa]), join([sb, qb]))


NODE = ("row long, leaf long, at long, closed boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>, "
        "n_a long, n_b long, n_groups long, n_links long, text string, pairs array<long>, times array<long>, wrong boolean")
NAMES = [part.split()[0] for part in NODE.split(", ")]


def _node(row, leaf, start, found: tuple) -> dict:
    """A fragment as a row; ``at`` is where it starts, until its first shared end is known."""
    closed, first, *lists = found
    return {"row": row, "leaf": leaf, "at": first if closed else start, "closed": closed,
            **{n: v.astype(np.int32) for n, v in zip(("pa", "pb", "sa", "sb"), lists)}, "wrong": False}


def _closed(row, found: Groups, names) -> dict:
    """Closed groups as a row; ``at`` is the end of the last one."""
    links, times, _ = found.links()
    known, places = np.unique(links, return_inverse=True)
    return {"row": row, "leaf": None, "at": int(found.ends[-1]), "n_a": len(found.a), "n_b": len(found.b), "n_groups": len(found.ends),
            "n_links": int(times.sum()), "text": "".join(found.texts(names)[0]), "pairs": known,
            "times": np.bincount(places, weights=times, minlength=len(known)).astype(np.int64), "wrong": False}


def _single(row, end: int, a: np.ndarray, b: np.ndarray, names) -> dict:
    """One group as a row; its tokens are given ends of which only the last is shared."""
    a_ends = np.append(np.arange(1 - len(a), 0), 0)
    b_ends = np.append(np.arange(1 - len(b), 0) * (len(a) + 1), 0)
    return {**_closed(row, Groups(a, a_ends, b, b_ends), names), "at": end}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in NAMES})


def _leaves(texts: DataFrame, first: str, second: str, chunk: int, size: int) -> DataFrame:
    """Fragments and closed groups of the byte ranges of long texts (``row``, ``text``)."""
    def parted(batches):
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                start = 0
                for part in units.cuts(" " + text, chunk):
                    yield pd.DataFrame({"row": [row], "start": [start], "text": [part]})
                    start += len(part.encode())

    def leaves(batches):
        left, right = units.ByteTokens(first), units.PieceTokens(second)
        names = _names(max(len(left.tokens), len(right.tokens)))
        for batch in batches:
            for row, start, text in zip(batch["row"], batch["start"], batch["text"]):
                sides = []
                for coder in (left, right):
                    ids = np.array(coder.encode([text])[0], np.int64)
                    whole = b"".join(map(coder.tokens.__getitem__, ids.tolist())) == text.encode()
                    sides.append((ids, start + np.cumsum(coder.lengths[ids]), whole))
                if not all(whole for *_, whole in sides):
                    yield _frame([{"row": row, "wrong": True}])
                    continue
                (a, a_ends, _), (b, b_ends, _) = sides
                rows = []
                for leaf in range(start // size, (int(a_ends[-1]) - 1) // size + 1):
                    (i, j), (k, m) = (np.searchsorted(ends, [leaf * size, (leaf + 1) * size], "right") for ends in (a_ends, b_ends))
                    if i < j or k < m:
                        found, inner = fragment(a[i:j], a_ends[i:j], b[k:m], b_ends[k:m])
                        rows.append(_node(row, leaf, max(start, leaf * size), found))
                        if inner is not None:
                            rows.append(_closed(row, inner, names))
                yield _frame(rows)

    parts = texts.mapInPandas(parted, "row long, start long, text string")
    return parts.repartition("row", "start").mapInPandas(leaves, NODE)


def _level(nodes: DataFrame, fan: int, last: bool, names_size: int) -> DataFrame:
    """Neighbouring fragments reduced, and the groups closed between them; the last level closes the first group of each text."""
    held: list = []  # the names, once for each task

    def reduced(group: pd.DataFrame) -> pd.DataFrame:
        held[:] = held or _names(names_size)
        names = held
        group = group.sort_values("at")
        row, leaf, rows, whole = group["row"].iloc[0], int(group["leaf"].iloc[0]) // fan, [], None
        start = int(group["at"].iloc[0])
        for item in group.itertuples(index=False):
            part = (item.closed, item.at, *(np.asarray(v, np.int64) for v in (item.pa, item.pb, item.sa, item.sb)))
            whole, closed = (part, None) if whole is None else compose(whole, part)
            if closed:
                rows.append(_single(row, *closed, names))
        if not last:
            rows.append(_node(row, leaf, start, whole))
        elif not whole[0] or len(whole[4]) or len(whole[5]):
            rows.append({"row": row, "wrong": True})  # the two sides do not end together
        else:
            rows.append(_single(row, *whole[1:4], names))
        return _frame(rows)

    keys = [F.col("row")] if last else [F.col("row"), F.floor(F.col("leaf") / fan)]
    return nodes.where("leaf is not null").groupBy(*keys).applyInPandas(
        lambda group: reduced(group), NODE)


def _digests(rows: DataFrame, written: bool) -> DataFrame:
    """row, groups_sha256 of long texts: their strings hashed in order, one at a time."""
    def hashed(batches):
        row, digest, parts, behind = None, None, [], False

        def done():
            return pd.DataFrame({"row": [row], "groups_sha256": [digest.hexdigest()], **({"groups": ["".join(parts)]} if written else {})})

        for batch in batches:
            for number, text in zip(batch["row"], batch["text"]):
                if number != row:
                    if row is not None:
                        yield done()
                    row, digest, parts, behind = number, hashlib.sha256(), [], False
                text = (";" if behind else "") + text[:-1]
                behind = True
                digest.update(text.encode())
                if written:
                    parts.append(text)
        if row is not None:
            yield done()

    ordered = rows.where("text is not null").select("row", "at", "text").repartition("row").sortWithinPartitions("row", "at")
    return ordered.mapInPandas(hashed, "row long, groups_sha256 string" + (", groups string" if written else ""))


def _long(texts: DataFrame, first: str, second: str, written: bool, chunk: int, size: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Long texts' figures by ``row``, and (row, a, b, times) of their links."""
    names_size = max(len(units.ByteTokens(first).tokens), len(units.PieceTokens(second).tokens))
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0] or 0
    nodes = write_once(_leaves(texts.select("row", "text"), first, second, chunk, size), "leaves")
    done, leaves = [nodes.where("leaf is null")], longest // size + 2
    while True:
        last = leaves <= fan
        nodes = write_once(_level(nodes, fan, last, names_size), "level")
        done.append(nodes.where("leaf is null"))
        if last:
            break
        leaves = (leaves - 1) // fan + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    wrong = rows.groupBy("row").agg(F.max("wrong").alias("wrong"), *(F.sum(n).alias(n) for n in TOTALS)).where("not wrong").drop("wrong")
    figures = wrong.join(_digests(rows, written), "row")
    pairs = rows.where("pairs is not null").join(wrong.select("row"), "row", "left_semi").select(
        "row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    links = pairs.groupBy("row", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("times"))
    return figures, links.select("row", F.shiftright("pair", 32).cast("int").alias("a"),
                                 F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "times")


def align(docs: DataFrame, first: str | None = None, second: str | None = None, written: bool = True, chunk: int = CHUNK,
          size: int = RANGE, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if ``written``, ``groups``."""
    first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    text = F.coalesce(F.col("text"), F.lit(""))
    all_rows = docs.select("doc_id", text.alias("text"))
    empty = (F.col("text") == "") | F.contains("text", F.lit(MARK))  # the mark would come back as a blank
    extra = ["groups_sha256"] + (["groups"] if written else [])
    numbers = [*TOTALS, "n_best", "count_sum"]
    usable = all_rows.where(~empty)
    short = usable.where(F.length("text") <= chunk).select("doc_id", F.concat(F.lit(" "), "text").alias("text"))
    blocks = write_once(_short(short, first, second, written), "blocks", **{"parquet.block.size": str(GROUP), "compression": "zstd"})
    found = blocks.where("row is not null").select("doc_id", "block", *TOTALS, "pairs", "times", *extra)
    pairs = blocks.where("row is null").select(F.col("block").alias("owner"), "place", "a", "b", "documents")
    long = write_once(usable.where(F.length("text") > chunk).select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "long")
    figures, links = _long(long, first, second, written, chunk, size, fan)
    links = write_once(links, "links")

    counts = pairs.select("a", "b", "documents").unionByName(links.select("a", "b", F.lit(1).cast("long").alias("documents"))).groupBy(
        "a", "b").agg(F.sum("documents").alias("documents"))
    counts = write_once(counts, "counts")
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))  # at most one row for each id of a
    rated = counts.join(F.broadcast(highest), "a").select("a", "b", F.col("documents").alias("count"),
                                                          (F.col("documents") == F.col("highest")).alias("best"))
    back = pairs.join(rated, ["a", "b"]).select("owner", "place", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join([f"doc_id {kind}", *(f"{n} long" for n in numbers), *(f"{n} string" for n in extra)])

    def summed(rows: pd.DataFrame, rates: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros(len(rates), np.int64), np.zeros(len(rates), np.int64)
        count[rates["place"]], best[rates["place"]] = rates["count"], rates["best"]
        sums, bests = [], []
        for packed, numbers in zip(rows["pairs"], rows["times"]):
            at = np.cumsum(np.frombuffer(packed, "<i4"))
            times = np.frombuffer(numbers, "<i4" if len(numbers) == len(packed) else "<i8").astype(np.int64)
            sums.append(int(count[at] @ times))
            bests.append(int(best[at] @ times))
        return rows.assign(count_sum=sums, n_best=bests)[["doc_id", *TOTALS, "n_best", "count_sum", *extra]]

    one = found.groupBy("block").cogroup(back.groupBy("owner")).applyInPandas(summed, fields)
    sums = links.join(rated, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    other = long.select("doc_id", "row").join(figures, "row", "left").join(sums, "row", "left").select(
        "doc_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in numbers), *(F.coalesce(n, F.lit("")).alias(n) for n in extra))
    none = all_rows.where(empty).select("doc_id", *(F.lit(0).cast("long").alias(n) for n in numbers), *(F.lit("").alias(n) for n in extra))
    return one.unionByName(other).unionByName(none)
