"""Traces: spans with ``trace_id, span_id, parent_id, service, operation, start_us, duration_us``.

A span whose parent is null, or is not in its trace, is a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.plans.slices import attach, scan, slice_count, summarize
from obsframe.session import write_once

FAMILY = 64  # spans of a trace that are held beside each of them

def sample_traces(spans: DataFrame, percent: float) -> DataFrame:
    """Keep about ``percent`` of the traces, each whole or not at all. A filter, no shuffle."""
    bucket = F.conv(F.substring(F.md5(F.col("trace_id").cast("string")), 1, 8), 16, 10).cast("long") % 10000
    return spans.where(bucket < round(percent * 100))


def service_edges(spans: DataFrame) -> DataFrame:
    """Caller to callee edges with calls and mean time.

    Children are first summed per parent and service, so a parent with very many
    children is one row per service before the join.
    """
    calls = spans.where(F.col("parent_id").isNotNull()).groupBy(
        "trace_id", F.col("parent_id").alias("span_id"), F.col("service").alias("callee"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_us").alias("time_us"))
    callers = spans.select("trace_id", "span_id", F.col("service").alias("caller"))
    return (calls.join(callers, ["trace_id", "span_id"]).groupBy("caller", "callee")
            .agg(F.sum("n").alias("calls"), (F.sum("time_us") / F.sum("n")).alias("mean_us")))


def span_self_time(spans: DataFrame) -> DataFrame:
    """Duration without the time of direct children, never below zero."""
    inner = spans.where(F.col("parent_id").isNotNull()).groupBy(
        "trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("duration_us").alias("child_us"))
    return spans.join(inner, ["trace_id", "span_id"], "left").withColumn(
        "self_us", F.greatest(F.col("duration_us") - F.coalesce("child_us", F.lit(0)), F.lit(0))).drop("child_us")


def span_performance(spans: DataFrame, by: tuple[str, ...] = ("service", "operation"),
                     slices: int | None = None) -> DataFrame:
    """Calls, mean and 95th percentile of the duration."""
    figures = [F.count(F.lit(1)).alias("calls"), F.avg("duration_us").alias("mean_us")]
    return summarize(spans, list(by), figures, "duration_us", {"p95_us": 0.95}, slices)


def trace_timeline(spans: DataFrame, slices: int | None = None) -> DataFrame:
    """Each span with its offset from the trace's start and its depth.

    Depth is null where a span hangs below a cycle. In traces of up to ``FAMILY`` spans a span finds its ancestors beside itself, so they
    are shuffled once; only larger traces are joined with themselves.
    """
    slices = slice_count(spans, slices)
    timed = scan(spans, ["trace_id"], ["span_id"], slices=slices, totals={
        "trace_start": ("min", F.col("start_us")), "__spans": ("count", F.lit(1))})
    is_large = F.col("__spans") > FAMILY
    out = _walk(timed.where(~is_large))
    sizes = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("__spans"))
    large = write_once(sizes.where(is_large).select("trace_id"), "large")
    if not large.isEmpty():
        rows = write_once(spans.select("trace_id", "span_id", "parent_id").join(large, "trace_id", "left_semi"), "large")
        depths = _depth_below(rows, slices).withColumnRenamed("span_id", "parent_id")
        found = attach(timed.where(is_large), depths, ["trace_id", "parent_id"], slices=slices)
        out = out.unionByName(found.withColumn("depth", F.when(F.col("known").isNull(), F.lit(0)).otherwise(F.col("below"))).drop("known", "below"))
    return out.select(*spans.columns, (F.col("start_us") - F.col("trace_start")).alias("offset_us"), "depth")


def _walk(timed: DataFrame) -> DataFrame:
    """Add ``depth``: steps up to a span whose parent is not in the trace, or null if as many steps as the trace has spans do not end there."""
    family = F.collect_list(F.struct("span_id", "parent_id")).over(Window.partitionBy("trace_id"))
    # no one is the child of a null trace's spans
    first = F.struct(F.when(F.col("trace_id").isNotNull(), F.col("parent_id")).alias("up"), F.lit(0).alias("depth"))

    def step(at: Column, _: Column) -> Column:
        parent = F.get(F.filter("__family", lambda s: s["span_id"] == at["up"]), F.lit(0))
        return F.when(at["up"].isNull(), at).otherwise(F.struct(
            parent["parent_id"].alias("up"), (at["depth"] + F.when(parent.isNull(), 0).otherwise(1)).alias("depth")))

    top = F.aggregate("__family", first, step)
    return timed.withColumn("__family", family).withColumn("__top", top).withColumn(
        "depth", F.when(F.col("__top.up").isNull(), F.col("__top.depth"))).drop("__family", "__top")


def _depth_below(spans: DataFrame, slices: int | None) -> DataFrame:
    """For each span that has children, the depth of those children.

    Only parents take part, which makes wide fans small. Each round every parent jumps
    to its jump target's target. No chain is longer than the parents of its trace, so
    ``log2`` of their largest number bounds the rounds; what still jumps then is in or below a cycle.
    """
    parents = spans.where(F.col("parent_id").isNotNull()).select(
        "trace_id", F.col("parent_id").alias("span_id")).distinct()
    inner = spans.select("trace_id", "span_id", "parent_id").join(parents, ["trace_id", "span_id"])
    above = inner.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("linked"))
    jumps = attach(inner, above, ["trace_id", "parent_id"], slices=slices).select(
        "trace_id", "span_id",
        F.when(F.col("linked"), F.col("parent_id")).alias("up"),
        F.when(F.col("linked"), 1).otherwise(0).alias("steps"))
    reached = 1
    jumps = write_once(jumps, "depth")
    longest = jumps.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    while reached <= longest and not jumps.where(F.col("up").isNotNull()).isEmpty():
        hop = jumps.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"),
                           F.col("steps").alias("steps2"))
        jumps = write_once(attach(jumps, hop, ["trace_id", "up"], slices=slices).select(
            "trace_id", "span_id", F.col("up2").alias("up"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")), "depth")
        reached *= 2
    return jumps.select("trace_id", "span_id", F.lit(True).alias("known"),
                        F.when(F.col("up").isNull(), F.col("steps") + 1).alias("below"))
