"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier learns from confirmed toxic texts and from texts without any label;
confirmed harmless texts are not used as negatives. With class prior ``prior`` and the
sigmoid loss, which is bounded and symmetric, the risk is

    prior * R(positives as toxic) + max(0, R(unlabelled as harmless) - prior * R(positives as harmless))

where the maximum keeps the corrected risk of the negatives from falling below zero: while
it would, only the first term has a slope. Training is minibatch gradient descent in numpy. The prior is the share of toxic labels among all usable labels.

Features are words (runs of letters, in lower case) and the windows of 5 and 6 characters in
them, the blanks at both ends included; they are hashed to 64 bits, and each counts once for a text. One can carry a
weight, and only for toxicity, if by the prior at least half of the unlabelled texts with it are
toxic, and if it is more frequent among the positives by ``DOUBT`` standard errors, and if the share ``SHARE`` of
the positives has it (other word lists vary too much by chance). The model is fitted on the driver from about ``PER_CLASS`` toxic and ``2 * PER_CLASS`` unlabelled
texts of at most ``LONGEST`` characters, of which only one stays where several share their
smallest hash of three words (copies would pass for evidence); it never sees the held-out
fold. Every whole text is scored, block by block.

A null or empty text gets the score of the learned bias. Labels, language, source and id
are no inputs of a score; repeated rows get equal scores. Without any toxic label every
text scores 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm.folds import held_out, sample
from obsframe.llm.windows import Hasher, blocks

PER_CLASS = 1500
LONGEST = 20_000
GRAMS = (5, 6)
DOUBT = 6.0
SHARE = 0.015
THRESHOLD = 0.3


def _plain(texts: list[str]) -> list[str]:
    """Lower case, with everything but letters as blanks."""
    table = _Letters()
    return [t.lower().translate(table) for t in texts]


class _Letters(dict):
    """Translation table that fills itself."""

    def __missing__(self, point: int):
        self[point] = point if chr(point).isalpha() else 32
        return self[point]


def _features(block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield block.words()
    for n in GRAMS:
        yield block.grams(n)


def feature_sets(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """For each whole text, the smallest hash of three words in a row and its distinct features."""
    hasher = Hasher()
    for text in _plain(texts):
        held = [hasher.block(parts) for _, parts in blocks([text])]
        row = np.concatenate([block.words()[1] for block in held])
        threes = held[0].mixed(row[2:] + row[1:-1] * np.uint64(3) + row[:-2] * np.uint64(5), 3) if len(row) > 2 else row
        found = np.concatenate([hashes for block in held for _, hashes in _features(block)])
        yield int(threes.min()) if len(threes) else 0, np.unique(found)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _rows(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the chosen rows in one array, and the place of the row each belongs to."""
    which = np.concatenate([rows[i] for i in chosen])
    return which, np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int,
          epochs: int = 300, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the bias, by the non-negative risk estimator."""
    draw = np.random.default_rng(seed)
    values, slope = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
    values[-1] = np.log(prior / (1 - prior))
    first, second, step = np.zeros(size + 1), np.zeros(size + 1), 0
    batches = max(1, min(len(positive), len(unlabelled), 500) // 125)
    for _ in range(epochs):
        for some_p, some_u in zip(np.array_split(draw.permutation(len(positive)), batches),
                                  np.array_split(draw.permutation(len(unlabelled)), batches)):
            (p, in_p), (u, in_u) = _rows(positive, some_p), _rows(unlabelled, some_u)
            out_p = np.bincount(in_p, weights=values[p], minlength=len(some_p)) + values[-1]
            out_u = np.bincount(in_u, weights=values[u], minlength=len(some_u)) + values[-1]
            chance_p, chance_u = _sigmoid(out_p), _sigmoid(out_u)
            to_p, to_u = -prior * chance_p * (1 - chance_p) / len(out_p), np.zeros(len(out_u))
            if chance_u.mean() > prior * chance_p.mean():  # else the maximum is flat
                to_p, to_u = 2 * to_p, chance_u * (1 - chance_u) / len(out_u)
            slope[:-1] = np.bincount(p, weights=to_p[in_p], minlength=size) + np.bincount(u, weights=to_u[in_u], minlength=size)
            slope[-1] = to_p.sum() + to_u.sum()
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
            values = values - rate * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-6)
            values[:-1] = np.maximum(values[:-1], 0)
    return values[:-1], float(values[-1])


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes with a weight, their weights, and the bias."""
    if not positive or not unlabelled or prior <= 0:
        return np.zeros(0, np.uint64), np.zeros(0), -50.0
    prior = min(prior, 0.9)
    known, in_p = np.unique(np.concatenate(positive), return_counts=True)
    other, often = np.unique(np.concatenate(unlabelled), return_counts=True)
    place = np.minimum(np.searchsorted(other, known), len(other) - 1)
    in_u = np.where(other[place] == known, often[place], 0) if len(other) else np.zeros(len(known))
    rate_p, rate_u = in_p / len(positive), (in_u + 1) / (len(unlabelled) + 1)
    known = known[(prior * rate_p >= rate_u / 2) & (in_p >= max(3, SHARE * len(positive)))
                  & (rate_p - rate_u > DOUBT * np.sqrt(rate_u * (1 - rate_u) / len(positive)))]
    rows = [[np.flatnonzero(np.isin(known, row, assume_unique=True)) for row in side] for side in (positive, unlabelled)]
    weights, bias = train(*rows, prior, len(known))
    return known[weights > 0], weights[weights > 0], bias


def margins(texts: list[str], known: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Classifier output for each whole text: each known feature counts once."""
    hasher, texts = Hasher(), _plain(texts)
    likely = np.zeros(1 << 16, bool)  # by the first 16 bits, so that most features need no search
    likely[known >> np.uint64(48)] = True
    seen = [np.zeros((0, 2), np.int64)]
    for owners, parts in blocks(texts):
        block, owners = hasher.block(parts), np.asarray(owners, np.int64)
        for at, hashes in _features(block):
            maybe = np.flatnonzero(likely[hashes >> np.uint64(48)])
            place = np.searchsorted(known, hashes[maybe])
            hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == hashes[maybe]) if len(known) else maybe[:0]
            seen.append(np.stack([owners[block.part_of(at[maybe[hit]])], place[hit]], 1))
    pairs = np.unique(np.concatenate(seen), axis=0)
    return np.bincount(pairs[:, 0], weights=weights[pairs[:, 1]], minlength=len(texts)) + bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on bounded samples of confirmed toxic texts and of texts without a label."""
    chosen, counts = sample(labels.select("doc_id", "toxic"), "toxic", per_class)
    prior = counts.get(1, 0.0) / max(1.0, sum(counts.values()))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(
        (F.length("text") <= LONGEST) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = texts.join(F.broadcast(chosen.where("label = 1")), "doc_id").select(F.lit(1).alias("label"), "text")
    rest = texts.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    total = docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = 2 * per_class / max(1, total) * 2.3  # three quarters are not held out, about 0.6 of these have no label
    plain = rest.where(place < share).select(F.lit(0).alias("label"), "text")

    def features(batches):
        for batch in batches:
            sets = list(feature_sets(batch["text"].tolist()))
            yield pd.DataFrame({"label": batch["label"], "kin": [str(k) for k, _ in sets], "features": [w.tobytes() for _, w in sets]})

    found = toxic.unionByName(plain).mapInPandas(features, "label int, kin string, features binary").groupBy("label", "kin").agg(
        F.min("features").alias("features")).collect()
    data = sorted((r["label"], bytes(r["features"])) for r in found)
    rows = {k: [np.frombuffer(w, np.uint64) for label, w in data if label == k] for k in (0, 1)}
    return learn(rows[1], rows[0], prior)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the chance that a text is toxic; an existing column ``name`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_sigmoid(margins(texts.tolist(), *shared.value)))

    return docs.withColumn(name, chance(F.coalesce(F.col("text"), F.lit(""))))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
