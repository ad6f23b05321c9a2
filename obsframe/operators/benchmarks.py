"""Benchmark records: rollup, comparison, contract checks, durations by model."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from obsframe import schemas
from obsframe.plans.slices import summarize
from obsframe.sources.manifests import get_text


def benchmark_rollup(requests: DataFrame, by: tuple[str, ...] = ("platform", "workload"),
                     slices: int | None = None) -> DataFrame:
    """Requests as benchmark figures. What was not measured is null, never zero."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    figures = [
        F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"), span.alias("duration_seconds"),
        F.avg("latency_ms").alias("average_latency_ms"), F.sum("tokens").alias("__tokens")]
    out = summarize(requests, list(by), figures, "latency_ms", {"p95_latency_ms": 0.95}, slices)
    rate = F.when(F.col("__tokens").isNotNull() & (F.col("duration_seconds") > 0),
                  F.try_divide(F.col("__tokens"), F.col("duration_seconds")))
    return out.withColumn("tokens_per_second", rate).drop("__tokens")


def compare_platforms(results: DataFrame, platforms: list[str], dimensions: list[str]) -> DataFrame:
    """One row per dimension, one column per platform."""
    long = results.select("platform", *[F.col(d).cast("string").alias(d) for d in dimensions]).unpivot(
        "platform", dimensions, "dimension", "value")
    return long.groupBy("dimension").pivot("platform", platforms).agg(F.first("value", ignorenulls=True))


def union_results(*results: DataFrame) -> DataFrame:
    """Append the records of several platforms; missing columns read null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def leaderboard(responses: DataFrame, by: str = "model", value: str = "duration", slices: int | None = None) -> DataFrame:
    """Number, total, mean, median, minimum and maximum of the durations of each model."""
    figures = [F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
               F.min(value).alias("min"), F.max(value).alias("max")]
    return summarize(responses, [by], figures, value, {"median": 0.5}, slices)


def model_rank(responses: DataFrame, baseline: str, task: str = "task", model: str = "model",
               value: str = "duration") -> DataFrame:
    """Rank models by duration within a task, and how many times slower than the baseline.

    ``responses`` has one row per task and model.
    """
    within = Window.partitionBy(task)
    base = F.max(F.when(F.col(model) == baseline, F.col(value))).over(within)
    return responses.withColumns({
        "rank": F.rank().over(within.orderBy(value)), "ratio": F.try_divide(F.col(value), base)})


def read_schema(spark: SparkSession, path: str) -> dict:
    """A JSON Schema file of flat records, for ``violations``."""
    text = get_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)


def violations(raw: DataFrame, document: str = "document", key: str = "id", schema: dict | None = None,
               totals: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per breach of a JSON Schema, compiled to column checks; by default that of benchmark records.

    ``document`` is JSON text. Of the schema ``required`` counts and, for each property, ``type`` (one or a list), ``enum``,
    ``minimum``, ``maximum``, ``minLength``, ``maxLength`` and ``pattern``. ``totals`` maps a count to those that add up to
    it; if they do not, that is a ``warning``.
    """
    if schema is None:
        schema, totals = schemas.benchmark_schema(), {"requests": ["successful_requests", "failed_requests"]}
    # One pass over the text gives every field as it was written; the checks below only
    # read the fields' kinds. Missing is null, JSON null is VOID.
    properties = schema.get("properties", {})
    names = [*properties, *(n for n in schema.get("required", []) if n not in properties)]
    counts = sorted({n for total, parts in (totals or {}).items() for n in (total, *parts)})
    place = {name: f"f{i}" for i, name in enumerate([*names, *(c for c in counts if c not in names)])}
    shape = T.StructType([T.StructField(n, T.VariantType()) for n in place] + [T.StructField("__bad", T.StringType())])
    fields = F.from_json(document, shape, {"columnNameOfCorruptRecord": "__bad"})
    rows = raw.withColumn("__doc", fields)
    value = {n: F.col("__doc").getField(n) for n in place}
    rows = rows.withColumns({f"__{place[n]}": F.schema_of_variant(value[n]) for n in names})
    readable = F.coalesce(F.ltrim(document).startswith("{"), F.lit(False)) & F.col("__doc.__bad").isNull()
    checks: list[Column] = [F.when(~readable, _breach("", "unreadable"))]
    for name in names:
        rules, kind = properties.get(name, {}), F.col(f"__{place[name]}")
        there = readable & kind.isNotNull()
        if name in schema.get("required", []):
            checks.append(F.when(readable & kind.isNull(), _breach(name, "required")))
        for rule, broken in _rules(rules, kind, value[name]):
            checks.append(F.when(there & broken, _breach(name, rule)))
    number = {n: F.try_variant_get(value[n], "$", "long") for n in counts}
    for total, parts in (totals or {}).items():
        checks.append(F.when(readable & (reduce(lambda a, b: a + b, [number[n] for n in parts]) != number[total]), _breach(total, "warning")))
    breaches = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return rows.select(key, F.explode(breaches).alias("v")).select(key, "v.field", "v.rule")


def _rules(rules: dict, kind: Column, value: Column) -> list[tuple[str, Column]]:
    """Names of a property's rules and when they are broken, given the kind of its value as Spark writes it."""
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    fits = {"string": kind == "STRING", "integer": whole, "number": numeric, "boolean": kind == "BOOLEAN", "null": kind == "VOID",
            "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY")}
    out = []
    types = rules.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types:
        out.append(("type", ~reduce(lambda a, b: a | b, [fits[t] for t in types])))
    if "enum" in rules:
        listed = [str(v).lower() if isinstance(v, bool) else str(v) for v in rules["enum"] if v is not None]
        text = F.try_variant_get(value, "$", "string")
        other = F.coalesce(~text.isin(*listed), F.lit(False)) if listed else text.isNotNull()
        out.append(("enum", other if None in rules["enum"] else other | fits["null"]))
    size, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    bounds = {"minimum": lambda v: size < v, "maximum": lambda v: size > v}
    lengths = {"minLength": lambda v: F.length(text) < v, "maxLength": lambda v: F.length(text) > v, "pattern": lambda v: ~text.rlike(v)}
    out += [(rule, numeric & broken(rules[rule])) for rule, broken in bounds.items() if rule in rules]
    return out + [(rule, fits["string"] & broken(rules[rule])) for rule, broken in lengths.items() if rule in rules]


def _breach(field: str, rule: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"))
