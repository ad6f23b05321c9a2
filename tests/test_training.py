import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from obsframe.operators import functional as f
from obsframe.operators import training as t


@pytest.fixture(params=[1, 4])
def slices(request):
    return request.param


@pytest.mark.parametrize("rows, percent, kept", [(1000, 1, 10), (250, 1, 3), (10, 1, 0), (10, 100, 10)])
def test_head_split_rounds_to_rows(spark, rows, percent, kept, slices):
    got = t.split_head(spark.range(rows), percent, ["id"], slices)
    assert sorted(r.id for r in got.collect()) == list(range(kept))


def test_shuffle_is_repeatable_and_differs_by_epoch(spark, slices):
    order = lambda epoch: [r.id for r in t.epoch_shuffle(spark.range(50), "id", epoch, slices).orderBy("position").collect()]
    assert order(1) == order(1) != order(2)
    assert sorted(order(1)) == list(range(50))


@pytest.mark.parametrize("rows, workers", [(10, 4), (8, 4), (2, 5), (1, 3)])
def test_shards_are_equal(spark, rows, workers, slices):
    got = t.worker_shard(spark.range(rows), workers, ["id"], slices).orderBy("position").collect()
    size = -(-rows // workers)
    assert [r.id for r in got] == [i % rows for i in range(size * workers)]
    assert [r.shard for r in got] == [i % workers for i in range(size * workers)]


def test_batches(spark, slices):
    got = t.make_batches(spark.range(10), 4, ["id"], slices).orderBy("id").collect()
    assert [r.batch for r in got] == [0] * 4 + [1] * 4 + [2] * 2 and {r.steps_per_epoch for r in got} == {3}


def test_encoding_cuts_pads_and_masks(spark, slices):
    df = spark.createDataFrame([(1, "b a  b\nc"), (2, ""), (3, "zz A"), (4, None)], "doc_id long, text string")
    vocab = t.build_vocab(df.where("doc_id < 2"), slices=slices)
    assert {r.word: r.id for r in vocab.collect()} == {"b": 2, "a": 3, "c": 4}
    got = {r.doc_id: (r.input_ids, r.attention_mask) for r in t.encode_fixed(df, vocab, length=3, slices=slices).collect()}
    assert got == {1: ([2, 3, 2], [1, 1, 1]), 2: ([0, 0, 0], [0, 0, 0]), 3: ([1, 3, 0], [1, 1, 0]), 4: ([0, 0, 0], [0, 0, 0])}


def test_pad_falls_back():
    assert (t.choose_pad(5, 6, 7), t.choose_pad(None, 6, 7), t.choose_pad(None, None, 7), t.choose_pad(0, 6)) == (5, 6, 7, 0)


def test_epochs(spark):
    steps = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (0, 3, 9.0), (1, 1, None)], "epoch int, step int, loss double")
    assert {r.epoch: r.loss for r in t.epoch_loss(steps).collect()} == {0: 5.0, 1: None}
    assert {r.epoch: r.loss for r in t.epoch_loss(steps, 2).collect()} == {0: 3.0, 1: None}
    assert t.resume_epoch(steps).first()[0] == 2 and t.resume_epoch(steps.limit(0)).first()[0] == 0


def test_chat_checks(spark, slices):
    talk = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "system", "s"), (1, 3, "assistant", "b"),
            (2, 0, "user", "a"), (2, 1, "system", "s"), (2, 2, "user", " "), (3, 0, "tool", "x"), (4, 0, "system", "only")]
    df = spark.createDataFrame(talk, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.valid, r.repeated_roles, r.empty_messages, r.unknown_roles, r.ends_with_assistant)
           for r in t.validate_chat(df, slices=slices).collect()}
    assert got == {1: (True, 0, 0, 0, True), 2: (False, 1, 1, 0, False), 3: (False, 0, 0, 1, False), 4: (False, 0, 0, 0, False)}


def test_user_functions(spark):
    df = spark.range(5, numPartitions=2)
    assert sorted(r.y for r in f.map_rows(df, lambda row: {"y": row["id"] + 1}, "y long").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.y for r in f.map_batches(df, lambda b: b.rename(columns={"id": "y"}) * 2, "y long").collect()) == [0, 2, 4, 6, 8]
    nulls = spark.sql("select explode(array(1, null)) x")
    assert [r.y for r in f.map_rows(nulls, lambda row: {"y": str(row["x"])}, "y string").collect()] == ["1", "None"]
    model = lambda: lambda x: x * 10.0
    out = f.predict_batches(df.select(F.col("id").cast("double").alias("x")), model, ["x"], "y", DoubleType(), 2)
    assert sorted(r.y for r in out.collect()) == [0, 10, 20, 30, 40]
    seen = f.inspect(df).first()
    assert (seen["rows"], seen.partitions, seen.columns, seen["schema"]) == (5, 2, 1, "struct<id:bigint>")


def test_any_tokenizer_encodes_like_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "A zzz " * 9)], "doc_id int, text string")
    vocab = t.build_vocab(spark.createDataFrame([("a b b",)], "text string"))
    ids = {r.word: r.id for r in vocab.collect()}

    def make():
        return lambda texts: [[ids.get(w, t.UNKNOWN_ID) for w in text.lower().split()] for text in texts]

    got, want = t.encode_with(docs, make, length=8), t.encode_fixed(docs, vocab, length=8)
    assert sorted((r.doc_id, r.input_ids, r.attention_mask) for r in got.collect()) == sorted((r.doc_id, r.input_ids, r.attention_mask) for r in want.collect())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
