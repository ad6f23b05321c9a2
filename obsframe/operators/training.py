"""Preparing text for training: order, shards, batches, fixed-length ids, run bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.functions.text import mask_for, pad_to
from obsframe.plans.slices import WHOLE_BYTES, attach, lookup_join, scan, settle

SEQUENCE_LENGTH = 512  # fixed value: ids per example
PAD_ID, UNKNOWN_ID, FIRST_WORD_ID = 0, 1, 2
CHAT_ROLES = ("system", "user", "assistant")


def number_rows(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """Add the 1-based ``position`` in the whole table and the table's ``rows``."""
    return scan(df, [], order, sums={"position": F.lit(1)}, totals={"rows": ("count", F.lit(1))}, slices=slices)


def split_head(df: DataFrame, percent: float, order: list[str], slices: int | None = None) -> DataFrame:
    """The first ``percent`` of the rows in the given order, rounded to whole rows."""
    numbered = number_rows(df, order, slices)
    return numbered.where(F.col("position") <= F.round(F.col("rows") * percent / 100)).drop("position", "rows")


def epoch_shuffle(df: DataFrame, key: str, epoch: int, slices: int | None = None) -> DataFrame:
    """A reproducible random order that differs by epoch, as a ``position`` column."""
    mixed = df.withColumn("__mix", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{epoch}"))))
    return number_rows(mixed, ["__mix", key], slices).drop("__mix", "rows")


def worker_shard(df: DataFrame, workers: int, order: list[str], slices: int | None = None) -> DataFrame:
    """Deal rows to workers in turn; the first rows are repeated until all shards are equal."""
    numbered = number_rows(df, order, slices)
    rows, spot = F.col("rows"), F.col("position") - 1
    total = F.ceil(rows / workers) * workers
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((total - 1 - spot) / rows))
    return (numbered.withColumn("__round", F.explode(rounds))
            .withColumn("position", F.col("__round") * rows + spot)
            .withColumn("shard", F.pmod(F.col("position"), F.lit(workers)))
            .drop("__round", "rows"))


def make_batches(df: DataFrame, size: int, order: list[str], slices: int | None = None) -> DataFrame:
    """Add the 0-based ``batch`` and ``steps_per_epoch``."""
    numbered = number_rows(df, order, slices)
    return numbered.withColumns({
        "batch": F.floor((F.col("position") - 1) / size),
        "steps_per_epoch": F.ceil(F.col("rows") / size)}).drop("position", "rows")


def words(text: Column | str) -> Column:
    """Lower-case words, split at white space."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")


def choose_pad(pad: int | None = None, eos: int | None = None, unknown: int | None = UNKNOWN_ID) -> int | None:
    """The padding id: the pad token's, else the end token's, else the unknown token's."""
    return next((i for i in (pad, eos, unknown) if i is not None), None)


def build_vocab(df: DataFrame, text: str = "text", slices: int | None = None) -> DataFrame:
    """Words with ids by falling frequency, then by word. Ids 0 and 1 are reserved."""
    spread = df.select(F.explode(F.split(F.lower(text), r"\s+")).alias("word")).where(F.col("word") != "")
    counts = spread.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ordered = settle(counts.withColumn("__rare", -F.col("n")), slices, WHOLE_BYTES)
    ranked = scan(ordered, [], ["__rare", "word"], sums={"id": F.lit(1)}, slices=slices)
    return ranked.select("word", "n", (F.col("id") + FIRST_WORD_ID - 1).alias("id"))


def encode_fixed(df: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text",
                 length: int = SEQUENCE_LENGTH, pad: int = PAD_ID, slices: int | None = None) -> DataFrame:
    """Text to ``input_ids`` and ``attention_mask`` of a fixed length; unknown words get id 1.

    Words beyond ``length`` are cut before anything is joined. The vocabulary is
    broadcast only if Spark finds it small enough.
    """
    kept = F.slice(words(F.coalesce(F.col(text), F.lit(""))), 1, length)
    spread = df.select(key, F.posexplode_outer(kept).alias("pos", "word"))
    known = attach(spread, vocab.select("word", "id"), ["word"], "left", slices)
    place = F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNKNOWN_ID)).cast("int").alias("id")))
    ids = known.groupBy(key).agg(F.sort_array(F.collect_list(place))["id"].alias("ids"))
    return ids.select(key, pad_to("ids", length, pad).alias("input_ids"), mask_for("ids", length).alias("attention_mask"))


def encode_with(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list[int]]]], key: str = "doc_id", text: str = "text",
                length: int = SEQUENCE_LENGTH, pad: int = PAD_ID) -> DataFrame:
    """``encode_fixed`` by any tokenizer: ``make`` is called once in each task and gives a function from texts to lists of ids.

    Texts come in Arrow batches; nothing is shuffled. A null text is empty; ids beyond ``length`` are cut.
    """
    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = make()
        for batch in batches:
            ids = [list(found)[:length] for found in tokenize(batch[text].fillna("").tolist())]
            yield pd.DataFrame({key: batch[key], "ids": ids})

    ids = df.select(key, text).mapInPandas(encoded, T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return ids.select(key, pad_to("ids", length, pad).alias("input_ids"), mask_for("ids", length).alias("attention_mask"))


def resume_epoch(saved: DataFrame, epoch: str = "epoch") -> DataFrame:
    """The epoch to go on with: the last saved one plus 1, or 0."""
    return saved.agg(F.coalesce(F.max(epoch) + 1, F.lit(0)).alias("next_epoch"))


def epoch_loss(steps: DataFrame, debug_steps: int = 0) -> DataFrame:
    """Mean step loss per epoch, of the first ``debug_steps`` steps if that is above 0."""
    rows = steps.where(F.col("step") <= debug_steps) if debug_steps > 0 else steps
    return rows.groupBy("epoch").agg(F.count("loss").alias("steps"), F.avg("loss").alias("loss"))


def validate_chat(messages: DataFrame, key: str = "conv_id", order: str = "turn", slices: int | None = None) -> DataFrame:
    """Per conversation whether it has the chat format: known roles, no empty message,
    user and assistant in turn, an assistant at the end."""
    role = F.col("role")
    basic = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(~role.isin(*CHAT_ROLES)).alias("unknown_roles"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_messages"),
        (F.max_by("role", order) == "assistant").alias("ends_with_assistant"))
    talk = scan(messages.where(role != "system").select(key, order, "role"), [key], [order],
                previous={"__before": role}, slices=slices)
    again = talk.groupBy(key).agg(F.count_if(role == F.col("__before")).alias("repeated_roles"))
    out = lookup_join(basic, again, [key]).fillna(0, "repeated_roles")
    return out.withColumn("valid", (F.col("unknown_roles") == 0) & (F.col("empty_messages") == 0)
                          & (F.col("repeated_roles") == 0) & F.col("ends_with_assistant"))
