"""Byte-level BPE of whole texts, long ones in overlapping chunks, and decoding.

A text is first split into pieces by ``public_tokenizers.PATTERN``, then each piece is
merged by the ranks of a vocabulary file. Texts of at most ``CHUNK`` characters are done where
they are read. Longer ones are cut into chunks that overlap by ``OVERLAP`` characters
and dealt out, so one long text is split into pieces by many tasks. A scan that starts in
the middle of a text may be wrong at first; from the first boundary that it shares with the
scan of the chunk before, it is right, because the pattern never looks back. There the chunks are
stitched. Where an overlap holds no shared boundary (a run without any), the chunks are joined and
scanned again, with twice as many each time. The stitched pieces are dealt out again and encoded.

Ids are kept as little-endian unsigned 32-bit integers in one binary value. Decoding
concatenates the bytes of the ids. A null text is an empty one: no ids, no bytes. Every
row is encoded by itself, so null or repeated ids and extra columns make no difference;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.columns import spare
from obsframe.session import write_once

CHUNK = 1 << 16
OVERLAP = 1 << 10
TOGETHER = 500       # texts whose new pieces are merged in one go
HELD = 100_000       # pieces whose ids a task remembers
ENOUGH = 200         # bytes from which a piece is merged alone, with a heap
VOCABULARY = "byte_bpe_50k.tiktoken"
NEVER = 1 << 30
PLACES = 21          # bits of a place in the table of pairs


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines of a base64 token and its rank; its size bounds what is broadcast."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pairs:
    """Which two neighbours merge into which token, as a hash table in arrays; its size follows from the vocabulary's.

    The id of a token is its rank, so the lowest id among possible merges comes first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        keys, merged = np.array([k for k, _ in found], np.int64), np.array([m for _, m in found], np.int64)
        self.keys, self.merged = np.full(1 << PLACES, -1, np.int64), np.full(1 << PLACES, NEVER, np.int32)
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]          # of several for one place the last one gets it
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << PLACES) - 1)
        self.merged[at] = merged

    @classmethod
    def of(cls, single: np.ndarray, keys: np.ndarray, merged: np.ndarray) -> Pairs:
        """The table from its arrays, which is how it travels to workers: they may not have this module."""
        made = cls.__new__(cls)
        made.single, made.keys, made.merged = single, keys, merged
        return made

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first << 32 | second
        at, out = self.place(keys), np.full(len(keys), NEVER, np.int32)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.merged[at[left[hit]]]
            left = left[(held != -1) & ~hit]
            at[left] = (at[left] + 1) & ((1 << PLACES) - 1)
        return out


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[np.ndarray]:
    """Ids of many pieces: in each round every piece makes its merge of lowest rank, the leftmost among equals."""
    tokens = pairs.single[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    done: list[np.ndarray] = [tokens[:0]] * len(pieces)
    while len(tokens):
        rank = np.full(len(tokens), NEVER, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = pairs.ranks(tokens[inner], tokens[inner + 1])
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        sizes = np.diff(starts, append=len(tokens))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        ended = np.flatnonzero(least[starts] == NEVER)
        for i in ended.tolist():
            done[owner[starts[i]]] = tokens[starts[i]:starts[i] + sizes[i]]
        best = np.flatnonzero((rank == least) & (least != NEVER))
        best = best[np.diff(owner[best], prepend=-1) != 0]
        tokens[best] = rank[best]
        keep = least != NEVER
        keep[best + 1] = False
        tokens, owner = tokens[keep], owner[keep]
    return done


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs; entries of pairs that have changed since are skipped."""
    size = len(piece)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))  # where the next part starts, the last one did
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if j < size and (rank := ranks.get(piece[i:after[j]])) is not None:
            heapq.heappush(heap, (rank, i, after[j]))

    for i in range(size - 1):
        push(i)
    alive = [True] * size
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else size
        if j == size or after[j] != end:
            continue
        alive[j], after[i] = False, end
        if end < size:
            before[end] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[piece[i:after[i]]] for i in range(size) if alive[i]]


class Encoder:
    """Packs the ids of pieces and remembers those of recent ones."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs):
        self.ranks, self.pairs, self.known = ranks, pairs, {}

    def pack(self, texts: list[list[str]]) -> list[bytes]:
        """Packed ids of texts that are given as lists of pieces."""
        present = set().union(*texts)
        if len(self.known) + sum(p not in self.known for p in present) > HELD:
            self.known = {p: self.known[p] for p in present if p in self.known}
        new = [(p, p.encode()) for p in present if p not in self.known]
        short = [(p, raw) for p, raw in new if len(raw) < ENOUGH]
        for (p, _), ids in zip(short, merge_many([raw for _, raw in short], self.pairs)):
            self.known[p] = ids.astype("<u4").tobytes()
        for p, raw in new:
            if len(raw) >= ENOUGH:
                self.known[p] = np.array(_merge_long(raw, self.ranks), "<u4").tobytes()
        packed = [b"".join(map(self.known.__getitem__, pieces)) for pieces in texts]
        for p, raw in new:
            if len(raw) >= ENOUGH:
                del self.known[p]
        return packed


def _encoder(shared) -> Encoder:
    ranks, pairs = shared.value
    return Encoder(ranks, Pairs.of(*pairs))


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """Offsets and texts of overlapping chunks; the last reaches the end."""
    at = 0
    while True:
        yield at, text[at:at + size + overlap]
        if at + size + overlap >= len(text):
            return
        at += size


def scan(text: str, pattern) -> list[int]:
    """Ends of the pieces of a text."""
    return [m.end() for m in pattern.finditer(text)]


def stitch(parts: list[tuple[int, str, list[int]]], pattern) -> Iterator[tuple[str, list[int]]]:
    """From (offset, text, ends) of all chunks in order, texts made of whole pieces, and the pieces' ends."""
    offset, text, ends = parts[0]
    at, following, more = 0, 1, 1
    while following < len(parts):
        start, other, other_ends = parts[following]
        shared = {start, *(start + e for e in other_ends if e < len(other) or following + 1 == len(parts))}
        meet = next((offset + e for e in ends if e < len(text) and offset + e >= max(at, start) and offset + e in shared), None)
        if meet is not None:
            if meet > at:
                yield text[at - offset:meet - offset], [offset + e - at for e in ends if at < offset + e <= meet]
            offset, text, ends, at, more = start, other, other_ends, meet, 1
            following += 1
        else:
            text = text[at - offset:]
            for start, other, _ in parts[following:following + more]:
                text += other[at + len(text) - start:]
            offset, ends = at, scan(text, pattern)
            following, more = following + more, 2 * more
    if len(text) > at - offset:
        yield text[at - offset:], [offset + e - at for e in ends if offset + e > at]


def _short(docs: DataFrame, keep: list[str], pattern: str, shared, name: str, decoded: str | None) -> DataFrame:
    """The columns ``keep`` and the ids of short texts (the last column of ``docs``), a few hundred texts at a time."""
    made = [name, decoded] if decoded else [name]
    plain = docs.toDF(*(f"c{i}" for i in range(len(keep))), "text")  # the columns' own names may hold dots
    fields = plain.schema.fields[:-1] + [T.StructField(f"m{i}", T.BinaryType()) for i in range(len(made))]

    def encoded(batches):
        find, encoder = regex.compile(pattern).findall, _encoder(shared)
        tokens = _tokens(shared.value[0]) if decoded else []
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                ids = encoder.pack([find(t) for t in part.column("text").to_pylist()])
                new = [pa.array(ids, pa.binary())] + ([pa.array([_bytes(i, tokens) for i in ids], pa.binary())] if decoded else [])
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + new, [f.name for f in fields])

    return plain.mapInArrow(encoded, T.StructType(fields)).toDF(*keep, *made)


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    found = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return found


def _bytes(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _long(texts: DataFrame, pattern: str, shared, size: int, overlap: int) -> DataFrame:
    """Row number and ids of long texts (columns ``row``, ``text``)."""
    def cut(batches):
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                found = list(chunks(text, size, overlap))
                yield pd.DataFrame({"row": row, "offset": [o for o, _ in found], "text": [t for _, t in found]})

    def scanned(batches):
        compiled = regex.compile(pattern)
        for batch in batches:
            yield batch.assign(sizes=[np.diff(scan(t, compiled), prepend=0).astype(np.int32) for t in batch["text"]])

    def stitched(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        found = list(stitch([(o, t, np.cumsum(s).tolist()) for o, t, s in zip(group["offset"], group["text"], group["sizes"])], regex.compile(pattern)))
        return pd.DataFrame({"row": group["row"].iloc[0], "part": range(len(found)), "text": [t for t, _ in found],
                             "sizes": [np.diff(e, prepend=0).astype(np.int32) for _, e in found]})

    def encoded(batches):
        encoder = _encoder(shared)
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "part": batch["part"], "ids": [
                encoder.pack([[t[b - s:b] for s, b in zip(sizes, np.cumsum(sizes))]])[0] for t, sizes in zip(batch["text"], batch["sizes"])]})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [group["row"].iloc[0]], "ids": [b"".join(group.sort_values("part")["ids"])]})

    cuts = texts.select("row", "text").mapInPandas(cut, "row long, offset long, text string")
    ends = cuts.repartition("row", "offset").mapInPandas(scanned, "row long, offset long, text string, sizes array<int>")
    whole = ends.groupBy("row").applyInPandas(stitched, "row long, part long, text string, sizes array<int>")
    ids = whole.repartition("row", "part").mapInPandas(encoded, "row long, part long, ids binary")
    return ids.groupBy("row").applyInPandas(joined, "row long, ids binary")


def _share(spark, path: str | None):
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    pairs = Pairs(ranks)
    return spark.sparkContext.broadcast((ranks, (pairs.single, pairs.keys, pairs.merged)))


def _encode(docs: DataFrame, keep: list[str], path, pattern, name, size, overlap, decoded: str | None = None) -> DataFrame:
    shared = _share(docs.sparkSession, path)
    text, row, ids_name = (spare(docs, c) for c in ("_text", "_row", "_ids"))
    filled = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    columns = [F.col(f"`{c}`") for c in keep]
    short = _short(filled.where(F.length(text) <= size).select(*columns, text), keep, pattern, shared, name, decoded)
    long = write_once(filled.where(F.length(text) > size).select(*columns, text).withColumn(row, F.monotonically_increasing_id()), "long")
    ids = _long(long.select(F.col(row).alias("row"), F.col(text).alias("text")), pattern, shared, size, overlap)
    joined = long.select(*columns, row).join(ids.select(F.col("row").alias(row), F.col("ids").alias(ids_name)), row)
    joined = joined.select(*columns, F.col(ids_name).alias(name))
    return short.unionByName(decode(joined, path, name, decoded) if decoded else joined)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, name: str = "ids",
           size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns of ``docs`` and the ids of ``text``; an existing column ``name`` is replaced."""
    return _encode(docs, [c for c in docs.columns if c.lower() != name.lower()], path, pattern, name, size, overlap)


def decode(ids: DataFrame, path: str | None = None, source: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the bytes of the ids in ``source``; an id that the vocabulary lacks is an error."""
    shared = ids.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _tokens(shared.value)
        for batch in batches:
            yield pd.Series([_bytes(b, tokens) for b in batch], dtype=object)

    return ids.withColumn(name, raw(F.coalesce(F.col(source), F.lit(b""))))


def token_digests(docs: DataFrame, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of ``docs``."""
    both = _encode(docs.select("doc_id", "text"), ["doc_id"], path, public_tokenizers.PATTERN, "ids", size, overlap, "decoded")
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
