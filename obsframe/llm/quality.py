"""Quality of documents by supervised subword embeddings.

Words, and the character windows of 3 to 5 inside a word and its edges, are hashed into
``BUCKETS`` rows; each row holds a learned vector of ``WIDTH`` numbers. A document is the
average of the vectors of all its words and windows, followed by a linear layer and
softmax, trained by stochastic gradient descent in numpy. A structural word joins each
word: whether it repeats the word before it. It counts as ``STRUCTURE`` windows, about as many as a word has.

The model is fitted on the driver from a bounded sample of labelled rows outside the
held-out fold: about ``PER_CLASS`` rows of each class, of at most ``LONGEST`` characters each
(the bound of what is collected). Classes are weighted back to their true shares. For scoring the linear layer is folded
into the vectors, so each executor gets ``BUCKETS`` numbers. Every whole text is scored,
block by block, in memory that does not depend on its length.

A null or empty text has no words and gets the score of the learned bias, which is the
share of good documents. Only the text is an input. Repeated rows get equal scores; a
table without usable labels of both classes scores every text 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm.columns import own, spare
from obsframe.llm.folds import held_out, sample
from obsframe.llm.windows import Hasher, blocks

BUCKETS = 1 << 17
WIDTH = 8
GRAMS = (3, 4, 5)
PER_CLASS = 1000
LONGEST = 20_000
STRUCTURE = 12
EPOCHS = 6
THRESHOLD = 0.7


def _features(block, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Positions and bucket numbers of every word and window of a block, and how much each counts."""
    shift = np.uint64(64 - bits)
    at, hashes = block.words()
    yield at, (hashes >> shift).astype(np.int64), 1
    same, part = np.zeros(len(at), np.int64), block.part_of(at)
    same[1:] = (hashes[1:] == hashes[:-1]) & (part[1:] == part[:-1])
    yield at, same, STRUCTURE  # buckets 0 and 1
    for n in GRAMS:
        at, hashes = block.grams(n)
        yield at, (hashes >> shift).astype(np.int64), 1


def bags(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, its bucket numbers and how often each occurs."""
    hasher, bits = Hasher(), buckets.bit_length() - 1
    for text in texts:
        total = np.zeros(buckets, np.int64)
        for _, parts in blocks([text]):
            for _, which, times in _features(hasher.block(parts), bits):
                total += times * np.bincount(which, minlength=buckets)
        which = np.flatnonzero(total)
        yield which, total[which]


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], shares: dict[int, float], buckets: int = BUCKETS,
          width: int = WIDTH, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit vectors and the softmax layer; return the margin of each bucket and the bias.

    Rows are (label, buckets, counts). Steps are scaled by the root of the squared
    gradients seen so far, so rare buckets learn as fast as frequent ones.
    """
    labels = np.array([r[0] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return np.zeros(buckets, np.float32), 0.0
    have = np.bincount(labels, minlength=2)
    weight = np.array([shares.get(k, 1.0) / have[k] for k in (0, 1)])
    weight = weight / (weight * have).sum() * len(labels)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    layer = draw.uniform(-1, 1, (width, 2)).astype(np.float32)
    bias = np.log(np.array([shares.get(0, 1.0), shares.get(1, 1.0)], np.float32) / sum(shares.values()))
    seen_vectors = np.full(buckets, 1e-8, np.float32)
    seen_layer = np.full((width, 2), 1e-8, np.float32)
    size, rate = 16, 0.3
    steps = epochs * ((len(rows) + size - 1) // size)
    done = 0
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for first in range(0, len(rows), size):
            chosen = order[first:first + size]
            which = np.concatenate([rows[i][1] for i in chosen])
            share = np.concatenate([(rows[i][2] / max(1, rows[i][2].sum())).astype(np.float32) for i in chosen])
            doc = np.repeat(np.arange(len(chosen)), [len(rows[i][1]) for i in chosen])
            hidden = np.zeros((len(chosen), width), np.float32)
            taken = vectors[which] * share[:, None]
            for j in range(width):
                hidden[:, j] = np.bincount(doc, weights=taken[:, j], minlength=len(chosen))
            logits = hidden @ layer + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(chosen)), labels[chosen]] -= 1
            error = (chance * weight[labels[chosen]][:, None]).astype(np.float32)
            back, to_layer = error @ layer.T, hidden.T @ error
            step = rate * (1 - done / steps)
            done += 1
            some, place = np.unique(which, return_inverse=True)
            gradient = np.stack([np.bincount(place, weights=share * back[doc, j], minlength=len(some))
                                 for j in range(width)], 1).astype(np.float32)
            seen_vectors[some] += (gradient ** 2).mean(1)
            vectors[some] -= step * gradient / np.sqrt(seen_vectors[some])[:, None]
            seen_layer += to_layer ** 2
            layer -= step * to_layer / np.sqrt(seen_layer)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def margins(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Difference of the two softmax inputs for each whole text."""
    hasher, bits = Hasher(), len(weights).bit_length() - 1
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, parts in blocks(texts):
        block = hasher.block(parts)
        for at, which, times in _features(block, bits):
            np.add.at(total, owners, times * block.per_part(at, weights[which]))
            np.add.at(count, owners, times * block.per_part(at, np.ones(len(at))))
    return total / np.maximum(count, 1) + bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled rows that are not held out."""
    chosen, shares = sample(labels.select("doc_id", "quality"), "quality", per_class)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text")

    def bag(batches):
        for batch in batches:
            found = list(bags(batch["text"].tolist()))
            yield pd.DataFrame({"label": batch["label"], "which": [w.astype(np.int32).tobytes() for w, _ in found],
                                "often": [n.astype(np.int32).tobytes() for _, n in found]})

    found = rows.mapInPandas(bag, "label int, which binary, often binary").collect()
    data = sorted((r["label"], bytes(r["which"]), bytes(r["often"])) for r in found)
    return train([(k, np.frombuffer(w, np.int32), np.frombuffer(n, np.int32)) for k, w, n in data], shares)


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the chance that a text is good; an existing column ``name`` is replaced."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-margins(texts.tolist(), *weights.value))))

    return docs.withColumn(name, chance(F.coalesce(F.col("text"), F.lit(""))))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with their own columns."""
    name = spare(docs, "_quality")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= THRESHOLD).select(*own(docs))
