"""Prompts and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.text import strip
from obsframe.plans.slices import attach, lookup_join
from obsframe.schemas import MODEL_OUTPUT


def prompt_response_join(prompts: DataFrame, responses: DataFrame, slices: int | None = None) -> DataFrame:
    """Each response with the prompt of its task; ``prompts`` has one row per task."""
    return attach(responses, prompts, ["task"], "inner", slices)


def side_by_side(responses: DataFrame, base: str, other: str, value: str = "body") -> DataFrame:
    """Per task the baseline's and another model's answer; null where one has none.

    One row per task and model is expected, so an aggregate replaces the self-join.
    """
    pick = lambda model: F.max(F.when(F.col("model") == model, F.col(value)))
    return (responses.where(F.col("model").isin(base, other)).groupBy("task")
            .agg(pick(base).alias("base"), pick(other).alias("other")))


def coverage(responses: DataFrame, tasks: DataFrame, models: list[str]) -> DataFrame:
    """Every task and model, with 1 where a response is present, else 0.

    The models wanted are an argument, as the columns of a pivot are.
    """
    grid = tasks.select("task").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    present = responses.groupBy("task", "model").agg(F.lit(1).alias("seen"))
    return lookup_join(grid, present, ["task", "model"]).select("task", "model", F.coalesce("seen", F.lit(0)).alias("present"))


def missing_responses(responses: DataFrame, tasks: DataFrame, models: list[str]) -> DataFrame:
    """Only the cells of the coverage grid without a response."""
    return coverage(responses, tasks, models).where(F.col("present") == 0).drop("present")


def prompt_id_audit(prompts: DataFrame) -> DataFrame:
    """Prompts whose own id differs from the key in their file name."""
    return prompts.where(~F.col("id").eqNullSafe(F.col("task"))).select("task", "id")


def normalize_prompts(prompts: DataFrame) -> DataFrame:
    """Strip each prompt and add its length in characters."""
    return prompts.select("id", strip("prompt").alias("prompt")).withColumn(
        "length", F.char_length("prompt").cast("long"))


def response_text(output: Column | str) -> Column:
    """The ``output_text`` parts of a model's nested JSON output as one text."""
    items = F.from_json(F.col(output) if isinstance(output, str) else output, MODEL_OUTPUT)
    parts = F.flatten(F.transform(items, lambda m: F.coalesce(m["content"], F.array())))
    texts = F.filter(parts, lambda p: p["type"] == "output_text")
    return F.array_join(F.transform(texts, lambda p: p["text"]), "")
