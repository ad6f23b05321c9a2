"""The trie of the common beginnings of conversations, from neighbours in sorted order.

A turn is the digest of its role and text, a conversation the string of its turns' digests. Conversations are sorted by that
string over all partitions, then by id, so the members of a node are neighbours. Each pair of neighbours has an edge
as deep as their common beginning. A partition takes its edges from the deepest to the shallowest and joins with
each the two components it connects (union-find); where they meet is a branching node, and the nodes below it that
contain one component alone are complete, with the sums over their subtrees.

Not complete are the nodes on the way to a partition's first and last conversation. They are all that is left of a
partition's forest: two spines, joined at the top. Neighbouring partitions' spines are merged in the same way over the
edge between them, ``FAN`` at a time, which closes all that lies inside; the last merge closes the rest. So no task sees more than
``RUN`` conversations and ``FAN`` pairs of spines at once. Conversations with equal turns are dealt over several partitions by
their ids. A row holds 40 bytes for each turn of one conversation.

Turns are ordered by number (null first), equal numbers by the digest. A null role or text is empty. Rows without a
conversation id belong to no conversation and are left out. Repeated rows are further turns. Extra columns
are not used. An empty table gives an empty result, without a root. The ids of the conversations that end at one node are hashed in
order as they stream through one task, because the digest asks for that.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.plans.slices import attach
from obsframe.session import write_once

FAMILY, MOST = 5, 9   # fixed values: conversations that share a beginning, and the modulus of its length
WIDE = 32             # characters of a turn's digest
RUN = 20_000
FAN = 32

CLOSED = "key string, parent string, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
KEY, N, LEAST, LEAVES, SAVED, CHILDREN, BYTES = range(7)  # fields of an open node


class Piece:
    """The open nodes of some neighbouring conversations: the spines to the first and the last one, equal up to depth ``shared``."""

    def __init__(self, first: str, last: str, left: list[list], right: list[list], shared: int):
        self.first, self.last, self.left, self.right, self.shared = first, last, left, right, shared


def single(conv_id: int, path: str, sizes) -> Piece:
    """The spine of one conversation."""
    key = hashlib.md5(b"").hexdigest()
    nodes = [[key, 1, conv_id, 0, 0, 0, 0]]
    for depth, size in enumerate(sizes):
        key = hashlib.md5((key + path[depth * WIDE:(depth + 1) * WIDE]).encode()).hexdigest()
        nodes.append([key, 1, conv_id, 0, 0, 0, int(size)])
    return Piece(path, path, nodes, nodes, len(nodes) - 1)


def common(a: str, b: str) -> int:
    """Turns that two conversations have in common from the start."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle * WIDE] == b[:middle * WIDE]:
            low = middle
        else:
            high = middle - 1
    return low


def _close(spine: list[list], depth: int, out: list[tuple]) -> None:
    """Complete the last node of a spine and add its sums to the one above."""
    node = spine[depth]
    leaves = node[LEAVES] if node[CHILDREN] else 1
    saved = node[SAVED] + (node[N] - 1) * node[BYTES]
    above = spine[depth - 1] if depth else None
    out.append((node[KEY], above and above[KEY], node[LEAST], depth, node[N], node[CHILDREN], leaves, saved))
    if above:
        above[LEAVES] += leaves
        above[SAVED] += saved
        above[CHILDREN] += 1


def _shorten(spine: list[list], depth: int, out: list[tuple]) -> None:
    """Complete all nodes of a spine below ``depth``."""
    for at in range(len(spine) - 1, depth, -1):
        _close(spine, at, out)
    del spine[depth + 1:]


def join(x: Piece, y: Piece, depth: int, open_left: bool, open_right: bool, out: list[tuple]) -> Piece:
    """Two neighbouring pieces as one, over an edge of the given depth.

    An end is open if conversations beyond it may still share its nodes.
    """
    if x.left is x.right and x.shared > depth:
        x.left = list(x.right)
    if y.left is y.right and y.shared > depth:
        y.right = list(y.left)
    _shorten(x.right, max(depth, x.shared), out)
    _shorten(y.left, max(depth, y.shared), out)
    if not open_left:
        _shorten(x.left, depth, out)
    if not open_right:
        _shorten(y.right, depth, out)
    for at in range(depth + 1):
        node, other = x.right[at], y.left[at]
        node[N] += other[N]
        node[LEAST] = min(node[LEAST], other[LEAST])
        for field in (LEAVES, SAVED, CHILDREN):
            node[field] += other[field]
        if at <= y.shared:
            y.right[at] = node
    inner = x.right[:depth + 1]
    _shorten(inner, max(min(x.shared, depth), min(y.shared, depth)), out)
    return Piece(x.first, y.last, x.left, y.right, min(x.shared, y.shared, depth))


def merge(pieces: list[Piece], out: list[tuple]) -> Piece:
    """Neighbouring pieces joined by their edges, the deepest first; both ends stay open."""
    depths = np.array([common(a.last, b.first) for a, b in zip(pieces, pieces[1:])], np.int64)
    parent, ends = list(range(len(pieces))), [(i, i) for i in range(len(pieces))]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    held: list = list(pieces)
    for edge in np.argsort(-depths, kind="stable").tolist():
        a, b = find(edge), find(edge + 1)
        whole = join(held[a], held[b], int(depths[edge]), ends[a][0] == 0, ends[b][1] == len(pieces) - 1, out)
        parent[b], held[a], held[b] = a, whole, None
        ends[a] = ends[a][0], ends[b][1]
    return held[find(0)]


def finish(piece: Piece, out: list[tuple]) -> None:
    """Complete all nodes of the last piece."""
    if piece.left is not piece.right:
        _shorten(piece.right, piece.shared, out)
    _shorten(piece.left, 0, out)
    _close(piece.left, 0, out)


def _frame(closed: list[tuple], ends: list[tuple] = (), place: int | None = None, piece: Piece | None = None) -> pd.DataFrame:
    rows = [(None, None, *row, False) for row in closed]
    rows += [(None, None, key, None, conv_id, None, None, None, None, None, True) for key, conv_id in ends]
    if piece is not None:
        rows.append((place, pickle.dumps(tuple(vars(piece).values())), *[None] * 8, False))
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object)


ROWS = f"place long, piece binary, {CLOSED}, ends boolean"
COLUMNS = [field.split()[0] for field in ROWS.split(", ")]


def _forests(sorted_rows: DataFrame) -> DataFrame:
    """Complete nodes, (key, conv_id) of the conversations' last nodes, and one piece for each partition."""
    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, whole, out, ends = [], None, [], []

        def closed():
            pieces = ([whole] if whole is not None else []) + run
            return merge(pieces, out)

        for batch in batches:
            for conv_id, path, sizes in zip(batch["conv_id"].tolist(), batch["path"], batch["sizes"]):
                run.append(single(conv_id, path, sizes))
                ends.append((run[-1].left[-1][KEY], conv_id))
                if len(run) >= RUN:
                    whole = closed()
                    yield _frame(out, ends)
                    run, out, ends = [], [], []
        if run or whole is not None:
            whole = closed()
            yield _frame(out, ends, TaskContext.get().partitionId(), whole)

    return sorted_rows.mapInPandas(forest, ROWS)


def _merged(pieces: DataFrame, fan: int, last: bool) -> DataFrame:
    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values("place"), []
        whole = merge([Piece(*pickle.loads(p)) for p in group["piece"]], out)
        if last:
            finish(whole, out)
            return _frame(out)
        return _frame(out, place=int(group["place"].iloc[0]) // fan, piece=whole)

    return pieces.select("place", "piece").groupBy(F.floor(F.col("place") / fan)).applyInPandas(merged, ROWS)


def _hashed(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the ids of the conversations that end at a node, in order."""
    def hashed(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for node, conv_id in zip(batch["key"], batch["conv_id"].tolist()):
                if node != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(f",{conv_id}".encode())
            yield pd.DataFrame(done, columns=["end", "ends_sha256"], dtype=object)
        if key is not None:
            yield pd.DataFrame({"end": [key], "ends_sha256": [digest.hexdigest()]})

    ordered = ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return ordered.mapInPandas(hashed, "end string, ends_sha256 string")


def turns_of(messages: DataFrame) -> DataFrame:
    """conv_id and its turns in order: digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = messages.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its family's first one in place of as many of its own."""
    keep = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    heads = conversations.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, MOST - 1).alias("head"))
    given = conversations.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    none = F.array().cast(conversations.schema["turns"].dataType)
    start = F.slice(F.coalesce("head", none), F.lit(1), keep.cast("int"))
    rest = F.slice("turns", (keep + 1).cast("int"), F.size("turns"))
    return given.select("conv_id", F.concat(start, rest).alias("turns"))


def trie(conversations: DataFrame, fan: int = FAN, partitions: int | None = None) -> DataFrame:
    """One row per node of the trie of conversations (``conv_id``, ``turns`` of ``digest`` and ``bytes``)."""
    paths = conversations.select("conv_id", F.array_join(F.col("turns")["digest"], "").alias("path"), F.col("turns")["bytes"].alias("sizes"))
    paths = write_once(paths, "paths")
    order: list[Column] = [F.col("path"), F.col("conv_id")]
    ranged = paths.repartitionByRange(partitions, *order) if partitions else paths.repartitionByRange(*order)
    found = write_once(_forests(ranged.sortWithinPartitions(*order)), "forests")
    tables, pieces = [found], found.where("piece is not null")
    places = (pieces.agg(F.max("place")).first()[0] or 0) + 1
    while True:
        last = places <= fan
        level = write_once(_merged(pieces, fan, last), "spines")
        tables.append(level)
        if last:
            break
        pieces, places = level.where("piece is not null"), (places - 1) // fan + 1
    nodes = tables[0].where("depth is not null")
    for more in tables[1:]:
        nodes = nodes.unionByName(more.where("depth is not null"))
    nodes = nodes.drop("place", "piece", "ends")
    ended = nodes.join(_hashed(found.where("ends")), nodes["key"] == F.col("end"), "left").drop("end")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return attach(ended, parents, ["parent"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(messages: DataFrame, fan: int = FAN, partitions: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of ``messages`` (conv_id, turn, role, text)."""
    return trie(rebuilt(turns_of(messages)), fan, partitions)
