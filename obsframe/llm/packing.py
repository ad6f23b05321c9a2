"""Best-fit packing of documents into sequences of a fixed number of tokens, planned on a histogram of lengths.

A document is its ids and an end id. Only documents longer than a sequence are cut, from their end backwards, so
that all pieces but the first fill a sequence. The plan sees lengths alone, longest first: ``n`` pieces of one length go
to the fullest sequences they fit, as many to each as fit. Sequences that are filled alike form one range of numbers,
so a step places any number of pieces at once, and the plan has a few entries for each length: a step that takes from a
range leaves it with less than half the room, so of at most ``3 * size`` ranges each is met ``log2(size)`` times at most.
That bounds what the driver holds and what is broadcast (under 70,000 entries of 40 bytes for 2048), whatever the number of documents.

Pieces then take the planned slots by their rank within their length. Each task numbers its own pieces of
each length as it writes them; the counts per task and length give the rank at which a task's pieces start. So a length that a
third of all documents have is ranked without bringing them together.

Texts of at most ``CHUNK`` characters are encoded where they are read; longer ones are cut between units into parts that
are encoded by different tasks, and their ids dealt into pieces.

A null or empty text is the end id alone. Rows are packed one by one: null or repeated ids and equal texts make no
difference. Extra columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.llm import units
from obsframe.session import write_once

SIZE = 2048
END = 0
CHUNK = 1 << 16
TOKENS = 500_000     # ids that are dealt into pieces at once
VOCABULARY = "byte_bpe_50k.json"


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces in each sequence, offset of the first) by length and rank.

    The pieces from the first rank up to the next entry's go to consecutive sequences.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}  # by room left: first sequence and number of sequences
    rooms: list[int] = []
    entries, fresh = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, count = size, fresh, -(-left // (size // length))
                fresh += count
            each = room // length
            full = min(count, left // each)
            if full:
                entries.append((length, rank, first, each, size - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                entries.append((length, rank, first + full, left, size - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, count - full)
    return sorted(entries)


def _short(docs: DataFrame, path: str, plain: bool, size: int, end: int, ids: bool) -> DataFrame:
    """doc_id, piece, start, length and the ids, or their checksums, of short texts."""
    made = ("ids", pa.binary()) if ids else ("ids_crc32", pa.int64())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = units.ByteTokens(path, plain), np.array([end], "<u4").tobytes()
        for block in units.blocks(batches, "text"):
            parts = units.Units(block.column("text"))
            rows, wrong = units.encode(parts, coder)
            if wrong.any():
                raise ValueError("the vocabulary does not cover all bytes")
            tokens = np.concatenate([np.zeros(1, np.int64), np.cumsum(rows.sizes()[parts.codes])])[parts.offsets]
            for low, high in units.slices(tokens, TOKENS):
                places, starts = rows.take(parts.codes[parts.offsets[low]:parts.offsets[high]])
                raw = memoryview(rows.values[places].astype("<u4").tobytes())
                bounds = (tokens[low:high + 1] - tokens[low]).tolist()
                out: list[list] = [[], [], [], [], []]
                for row, (begin, until) in enumerate(pairwise(bounds), low):
                    whole = bytes(raw[4 * begin:4 * until]) + last
                    count = until - begin + 1
                    at, number = 0, 0
                    while at < count:
                        after = at + ((count - at) % size or size)
                        piece = whole[4 * at:4 * after]
                        for column, value in zip(out, (row, number, at, after - at, piece if ids else zlib.crc32(piece))):
                            column.append(value)
                        at, number = after, number + 1
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.int64()), pa.array(out[4], made[1])], ["doc_id", "piece", "start", "length", made[0]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, {made[0]} {'binary' if ids else 'long'}")


def _long(docs: DataFrame, path: str, plain: bool, size: int, end: int, chunk: int) -> DataFrame:
    """doc_id, piece, start, length, ids of long texts."""
    texts = write_once(docs.withColumn("row", F.monotonically_increasing_id()), "long")

    def parted(batches):
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                for number, part in enumerate(units.cuts(text, chunk)):
                    yield pd.DataFrame({"row": [row], "part": [number], "text": [part]})

    def encoded(batches):
        coder = units.ByteTokens(path, plain)
        for batch in batches:
            found = coder.encode(batch["text"].tolist())
            yield pd.DataFrame({"row": batch["row"], "part": batch["part"], "ids": [np.array(i, "<u4").tobytes() for i in found]})

    parts = texts.select("row", "text").mapInPandas(parted, "row long, part long, text string")
    ids = parts.repartition("row", "part").mapInPandas(encoded, "row long, part long, ids binary")
    order = Window.partitionBy("row").orderBy("part")  # at most a few ten thousand parts, without their texts
    counts = write_once(ids, "ids")
    sizes = counts.select("row", "part", F.floor(F.octet_length("ids") / 4).alias("n"))
    placed = sizes.select("row", "part", "n", (F.sum("n").over(order) - F.col("n")).alias("at"),
                          (F.sum("n").over(Window.partitionBy("row")) + 1).alias("total"),
                          F.lead("part").over(order).isNull().alias("last"))
    first = F.when(F.col("total") % size == 0, size).otherwise(F.col("total") % size)

    def piece(at: Column) -> Column:
        return F.when(at < F.col("first"), 0).otherwise(F.floor((at - F.col("first")) / size) + 1)

    def start(number: Column) -> Column:
        return F.when(number == 0, F.lit(0)).otherwise(F.col("first") + (number - 1) * size)

    last = F.lit(np.array([end], "<u4").tobytes())
    whole = counts.join(placed, ["row", "part"]).withColumn("first", first).withColumn(
        "ids", F.when(F.col("last"), F.concat("ids", last)).otherwise(F.col("ids")))
    until = F.col("at") + F.floor(F.octet_length("ids") / 4)
    spread = whole.withColumn("until", until).where("until > at").withColumn(
        "piece", F.explode(F.sequence(piece(F.col("at")), piece(F.col("until") - 1))))
    low = F.greatest(F.col("at"), start(F.col("piece")))
    high = F.least(F.col("until"), start(F.col("piece") + 1))
    cut = spread.select("row", "piece", "total", "first", low.alias("low"), F.substring(
        F.col("ids"), ((low - F.col("at")) * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"))
    joined = cut.groupBy("row", "piece").agg(F.sort_array(F.collect_list(F.struct("low", "ids"))).alias("parts")).select(
        "row", F.col("piece").cast("int").alias("piece"), F.col("parts")[0]["low"].alias("start"),
        F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"])).alias("ids"))
    return texts.select("row", "doc_id").join(joined, "row").select(
        "doc_id", "piece", "start", F.floor(F.octet_length("ids") / 4).alias("length"), "ids")


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END, ids: bool = True, plain: bool = False,
           chunk: int = CHUNK) -> DataFrame:
    """doc_id, piece, start, length and ``ids`` (little-endian, 32 bits each), or ``ids_crc32`` in their place."""
    path = path or public_tokenizers.path(VOCABULARY)
    filled = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = _short(filled.where(F.length("text") <= chunk), path, plain, size, end, ids)
    long = _long(filled.where(F.length("text") > chunk), path, plain, size, end, chunk)
    return short.unionByName(long if ids else long.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def _numbered(found: DataFrame, size: int) -> DataFrame:
    """Add ``task`` and ``place``: who wrote a piece, and how many of its length that task wrote before."""
    def numbered(batches):
        seen, task = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            place = seen[batch["length"]] + batch.groupby("length").cumcount().to_numpy()
            seen += np.bincount(batch["length"], minlength=size + 1)
            yield batch.assign(task=task, place=place)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInPandas(numbered, f"{fields}, task int, place long")


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END, ids: bool = True, plain: bool = False,
         chunk: int = CHUNK) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: where each lies. Sequences are gapless from offset 0."""
    found = write_once(_numbered(pieces(docs, size, path, end, ids, plain, chunk), size), "pieces")
    counts = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    entries = np.array(plan(histogram, size), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(entries)
    order = Window.partitionBy("length").orderBy("task")
    bases = counts.select("task", "length", (F.sum("n").over(order) - F.col("n")).alias("base"))

    def slots(batches):
        length, rank, sequence, each, offset = shared.value.T
        keys = length << 44 | rank
        for batch in batches:
            wanted = (batch["base"] + batch["place"]).to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() << 44 | wanted, "right") - 1
            index = wanted - rank[at]
            yield batch.drop(columns=["task", "place", "base"]).assign(
                sequence_id=sequence[at] + index // each[at], offset=offset[at] + index % each[at] * length[at])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name not in ("task", "place")]
    ranked = found.join(bases, ["task", "length"]).select(*found.columns, "base")
    return ranked.mapInPandas(slots, ", ".join([*kept, "sequence_id long", "offset long"]))
