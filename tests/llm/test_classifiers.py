"""Quality and toxicity: held-out accuracy, defined results for odd rows, scores of whole texts."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import folds, quality, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs, spark.read.parquet(f"{FOLDER}/labels.parquet")


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows), len(rows)


def test_held_out_accuracy_of_quality(tables):
    docs, labels = tables
    share, n = accuracy(quality.quality_scores(docs, labels), labels, "quality")
    assert n > 900 and share > 0.98


def test_held_out_accuracy_of_toxicity(tables):
    docs, labels = tables
    share, n = accuracy(toxicity.toxicity_scores(docs, labels), labels, "toxic")
    assert n > 900 and share > 0.955


def test_fold(spark):
    ids = [*range(500), None]
    out = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", folds.held_out(F.col("doc_id")).alias("h"))
    for r in out.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_sample_is_bounded_and_clean(spark):
    rows = [(i, i % 3 != 0) for i in range(3000)] + [(5, True), (7, False), (None, True), (8, None)]
    labels = spark.createDataFrame([(i, None if v is None else int(v)) for i, v in rows], "doc_id long, toxic int")
    chosen, counts = folds.sample(labels, "toxic", 100)
    found = chosen.collect()
    assert 100 < len(found) < 300 and len({r.doc_id for r in found}) == len(found)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in found)
    assert sum(counts.values()) < 3000


MODEL_Q = (np.linspace(-1, 1, 1 << 10).astype(np.float32), 0.25)


def test_quality_of_odd_texts():
    texts = ["", " \n ", "a", "a b " * 400_000, "x" * 1_200_000, "good words here", "good words here"]
    out = quality.margins(texts, *MODEL_Q)
    assert out[0] == out[1] == 0.25 and out[5] == out[6] and np.isfinite(out).all()
    assert out.tolist() == [quality.margins([t], *MODEL_Q)[0] for t in texts]  # no text depends on its batch


def test_quality_matches_a_plain_average():
    weights, bias = MODEL_Q
    hasher, texts = quality.Hasher(), ["one two two three", "é  ü"]
    for text, margin in zip(texts, quality.margins(texts, weights, bias)):
        block, total, count = hasher.block([text]), 0.0, 0
        for _, which, times in quality._features(block, 10):
            total, count = total + times * weights[which].sum(dtype=float), count + times * len(which)
        assert margin == pytest.approx(total / count + bias, abs=1e-5)


def test_toxicity_counts_each_feature_once():
    (_, known), = toxicity.feature_sets(["idiot"])
    weights = np.ones(len(known))
    out = toxicity.margins(["", "idiot", "Idiot! idiot? IDIOT", "harmless", "idiot " * 200_000], known, weights, -2.0)
    assert out.tolist() == [-2, len(known) - 2, len(known) - 2, -2, len(known) - 2]


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_tables(spark, documents, module, label):
    run = {"quality": quality.quality_scores, "toxic": toxicity.toxicity_scores}[label]
    docs = documents([(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = run(docs, none).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    odd = spark.createDataFrame([(1, None, None), (1, 1, 1), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert run(docs, odd).count() == 5
    assert run(documents([]), none).count() == 0


def test_keep_good_keeps_columns(spark, documents):
    docs = documents([(i, "fine words in a row" if i % 2 else "### $$$ %%%") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(1, 400, 2))
