"""The pipeline against plain Python on what each stage got."""
import hashlib
import re
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from obsframe.llm import bpe, catalog, decontaminate
from test_decontaminate import brute as overlapping
from test_near_dup import brute as classes

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = [(None, docs)]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1][1], FOLDER).write.parquet(f"{tmp_path}/{i}")
        held.append((name, spark.read.parquet(f"{tmp_path}/{i}")))
    assert [n for n, _ in held[1:-1]] == [n for n, _ in corpus_pipeline.STAGES[:-1]]
    assert all(sorted(df.columns) == sorted(docs.columns) for _, df in held[:-1])
    rows = [{r.doc_id: r for r in df.collect()} for _, df in held]

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [i for i in rows[0] if quality.get(i) == 1]
    assert sum(i in rows[1] for i in good) / len(good) > 0.97
    bad = [i for i in rows[0] if quality.get(i) == 0]
    assert sum(i in rows[1] for i in bad) / len(bad) < 0.2

    first = {}
    for i in sorted(rows[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[1][i].text), i)
    assert set(rows[2]) == set(first.values())

    short = [(i, r.text) for i, r in rows[2].items() if len(r.text) < 500]  # all pairs of all texts would take too long here
    for i, name, _ in classes(short):
        assert (i in rows[3]) <= (i == name)
    kept_texts = {i: r.text for i, r in rows[3].items()}
    assert set(kept_texts) <= set(rows[2]) and len(kept_texts) > 0.5 * len(rows[2])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {g for _, t in items for w in [decontaminate_words(t)] for g in zip(w, w[1:], w[2:])}
    likely = [(i, t) for i, t in kept_texts.items() for w in [decontaminate_words(t)] if sum(g in grams for g in zip(w, w[1:], w[2:])) > 2]
    assert set(rows[4]) == set(rows[3]) - {d[0] for d in overlapping(likely, items)}

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        ids = library.encode_ordinary(rows[4][i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def decontaminate_words(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens"} <= set(out.columns) and 50 < out.count() < 200


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_against_their_sql(spark, name):
    import oracle
    df = catalog.QUERIES[name](spark, FOLDER)
    assert oracle.difference(df, oracle.connect(FOLDER), catalog.SQL[name]) is None


def test_everything_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
    import __spark_entry__
    assert {*catalog.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    others = [p for p in [*root.glob("obsframe/**/*.py"), *root.glob("tests/*.py")] if "llm" not in p.parts]
    assert others and not [p for p in others if re.search(r"obsframe[.]llm|import llm|corpus_pipeline", p.read_text())]
