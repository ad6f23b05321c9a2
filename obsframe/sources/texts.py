"""Text formats: response and prompt files, Markdown tables, metric exposition, probe logs.

Each reader is a file scan followed by a parse function, which also works on text rows
from elsewhere. ``parse_error`` marks rows that did not have the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_NAME = r"response-(.+)-([^-/]+)\.[A-Za-z]+$"
PROMPT_NAME = r"prompts-([^/]+)\.ya?ml$"


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``path`` and the whole ``value``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return parse_responses(whole_files(spark, path))


def parse_responses(files: DataFrame) -> DataFrame:
    """Model and task from the file name, duration from line 1, the rest after either marker.

    A body may hold lines that look like the first ones; they are left alone. Without a
    duration or a marker the whole text is the body and ``parse_error`` is true.
    """
    text = F.col("value")
    seconds = F.regexp_extract(text, r"^Duration: (\d+(?:\.\d+)?) seconds\.", 1).try_cast("double")
    form = r"(?s)\A[^\n]*\n\s*(?:Code generated|Output):\r?\n?(.*)\z"
    known = seconds.isNotNull() & text.rlike(form)
    model, task = _nonempty(F.regexp_extract("path", RESPONSE_NAME, 1)), _nonempty(F.regexp_extract("path", RESPONSE_NAME, 2))
    return files.select(model.alias("model"), task.alias("task"), seconds.alias("duration"),
                        F.when(known, F.regexp_extract(text, form, 1)).otherwise(text).alias("body"),
                        (model.isNull() | ~F.coalesce(known, F.lit(False))).alias("parse_error"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return parse_prompts(whole_files(spark, path))


def parse_prompts(files: DataFrame) -> DataFrame:
    """Task from the file name, own id from the ``id:`` line, block text whether indented or not.

    Without a block the prompt is empty and ``parse_error`` is true.
    """
    task = _nonempty(F.regexp_extract("path", PROMPT_NAME, 1))
    own = _nonempty(F.regexp_extract("value", r"^\s*id:[ \t]*([^\r\n]*)", 1))
    block = r"(?s)\nprompt:[ \t]*\|[^\n]*\n(.*)\z"
    body = F.regexp_extract("value", block, 1)
    return files.select(task.alias("task"), F.trim(own).alias("id"), body.alias("prompt"),
                        (task.isNull() | own.isNull() | ~F.col("value").rlike(block)).alias("parse_error"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return parse_matrices(whole_files(spark, path))


def parse_matrices(files: DataFrame) -> DataFrame:
    """Markdown tables to one row per cell. All in the row of the file: nothing is shuffled."""
    blocks = F.regexp_extract_all("value", F.lit(r"(?m)((?:^[ \t]*\|[^\n]*(?:\n|\z))+)"), F.lit(1))
    tables = files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), F.posexplode(blocks).alias("table_no", "block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda line: F.trim(line) != "")
    ruled = r"^[\s|:-]+$"
    tables = tables.withColumn("lines", F.filter(lines, lambda line, i: ~((i == 1) & line.rlike(ruled))))
    rows = tables.withColumn("header", _cells(F.get("lines", F.lit(0)))).select(
        "doc", "table_no", "header", F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("row_no", "line"))
    rows = rows.withColumn("cells", _cells(F.col("line")))
    return rows.select("doc", "table_no", "row_no", F.get("cells", F.lit(0)).alias("entity"),
                       F.posexplode("header").alias("column_no", "attribute"), "cells").where(
        F.col("column_no") > 0).select(
        "doc", "table_no", "row_no", "entity", "attribute", F.get("cells", F.col("column_no")).alias("value"))


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(c))


def parse_exposition(lines: DataFrame, value: str = "value") -> DataFrame:
    """Metric exposition lines ``name{label="x",..} value [ms]`` to samples.

    Comment and empty lines are not samples and are skipped; a line that is neither is
    kept and marked.
    """
    line = r'^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$'
    text = F.trim(F.col(value))
    rows = lines.where((text != "") & ~text.startswith("#"))
    pair = r'([A-Za-z_]\w*)\s*=\s*"((?:[^"\\]|\\.)*)"'
    inside = F.regexp_extract(text, line, 2)
    keys = F.regexp_extract_all(inside, F.lit(pair), F.lit(1))
    values = F.transform(F.regexp_extract_all(inside, F.lit(pair), F.lit(2)), _unescape)
    number = F.regexp_extract(text, line, 3)
    parsed = F.when(F.lower(number).isin("+inf", "inf"), F.lit(float("inf"))).when(
        F.lower(number) == "-inf", F.lit(float("-inf"))).otherwise(number.try_cast("double"))
    single = F.size(F.array_distinct(keys)) == F.size(keys)
    others = [c for c in lines.columns if c != value]
    return rows.select(
        *others, _nonempty(F.regexp_extract(text, line, 1)).alias("name"),
        F.when(single, F.map_from_arrays(keys, values)).alias("labels"),
        parsed.alias("value"), F.timestamp_millis(F.regexp_extract(text, line, 4).try_cast("long")).alias("ts"),
        F.when(~text.rlike(line) | parsed.isNull() | ~single, F.col(value)).alias("parse_error"))


def _unescape(text: Column) -> Column:
    held = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    plain = F.replace(F.replace(held, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\u0000"), F.lit("\\"))


def parse_traffic(lines: DataFrame, value: str = "value") -> DataFrame:
    """Probe lines ``HH:MM:SS: n code``."""
    form = r"^(\d{2}:\d{2}:\d{2}): (\d+) (\d{3})\s*$"
    part = lambda i: _nonempty(F.regexp_extract(value, form, i))
    others = [c for c in lines.columns if c != value]
    return lines.select(*others, part(1).alias("clock"), part(2).try_cast("long").alias("n"),
                        part(3).try_cast("int").alias("status"),
                        F.when(~F.col(value).rlike(form), F.col(value)).alias("parse_error"))


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)
