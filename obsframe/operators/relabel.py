"""Relabelling and matching of scrape targets.

Rules, monitors and settings are configuration: rules and monitors become literal
expressions in the plan, so a target never takes part in a join with them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.labels import label
from obsframe.functions.text import full_match
from obsframe.plans.slices import attach, settle


def _joined(df: DataFrame, sources: list[str]) -> Column:
    return F.concat_ws(";", *[label(df, s) for s in sources])


def relabel_keep(df: DataFrame, sources: list[str], pattern: str) -> DataFrame:
    """Keep rows whose source labels, joined by ``;``, match the whole pattern."""
    return df.where(full_match(_joined(df, sources), pattern))


def relabel_replace(df: DataFrame, sources: list[str], pattern: str, replacement: str, target: str) -> DataFrame:
    """Write ``target`` from the match's groups; rows that do not match stay as they are."""
    text = _joined(df, sources)
    written = F.regexp_replace(text, f"^(?:{pattern})$", replacement)
    return df.withColumn(target, F.when(full_match(text, pattern), written).otherwise(label(df, target)))


def namespace_filter(df: DataFrame, pattern: str, namespace: str = "namespace") -> DataFrame:
    """Targets of the namespaces a pattern such as ``ns1|ns2`` allows."""
    return df.where(full_match(label(df, namespace), pattern))


@dataclass(frozen=True)
class Monitor:
    """A label selector. ``namespaces=None`` stands for any namespace."""

    name: str
    match_labels: dict[str, str] = field(default_factory=dict)
    namespaces: tuple[str, ...] | None = None


def match_selector(targets: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """One row per target and monitor whose labels the target carries entirely."""
    hits = []
    for monitor in monitors:
        tests = [label(targets, k) == v for k, v in monitor.match_labels.items()]
        if monitor.namespaces is not None:
            tests.append(label(targets, "namespace").isin(*monitor.namespaces))
        hits.append(F.when(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(monitor.name)))
    return targets.withColumn("monitor", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def match_monitors(targets: DataFrame, monitors: DataFrame, labels: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """``match_selector`` for a table of monitors: ``monitor``, ``match_labels`` (a map) and ``namespaces`` (an array, null for any).

    A join by set containment: a monitor is filed under that one of its label pairs that the fewest targets have, without
    pairs under its namespaces, without these under all targets. A target looks up its own pairs only, and what it meets is checked in
    full. ``labels`` names the targets' label columns; without it they are read from the map ``labels``. A pair with an
    empty value also holds where the label is absent. A null map asks for nothing; a monitor with null labels in the map never matches.
    """
    given = F.create_map(*[x for name in labels for x in (F.lit(name), label(targets, name))]) if labels else F.coalesce(
        "labels", F.create_map().cast("map<string,string>"))
    own = F.map_filter(given, lambda _, value: value.isNotNull())
    rows = targets.withColumn("__own", own)
    wanted = monitors.select("monitor", F.coalesce("match_labels", F.create_map().cast("map<string,string>")).alias("wanted"), "namespaces")
    pair = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    written = F.filter(F.map_entries("wanted"), lambda e: e["value"] != "")

    # how many targets have each pair that some monitor asks for
    asked = wanted.select(F.explode(F.transform(written, lambda e: pair(e["key"], e["value"]))).alias("p")).distinct()
    has = rows.select(F.explode(F.map_entries("__own")).alias("e")).select(pair(F.col("e.key"), F.col("e.value")).alias("p"))
    counts = has.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(counts, "p", "left").select("p", F.coalesce("n", F.lit(0)).alias("n"))
    numbered = wanted.withColumn("__no", F.monotonically_increasing_id())
    numbered = settle(numbered, slices)
    rarest = numbered.select("__no", F.explode(F.transform(written, lambda e: pair(e["key"], e["value"]))).alias("p")).join(counted, "p").groupBy(
        "__no").agg(F.min_by("p", F.struct("n", "p")).alias("rarest"))
    anywhere = pair(F.lit(""), F.lit(""))
    by_namespace = F.transform(F.array_distinct("namespaces"), lambda n: pair(F.lit("namespace"), n))
    filed = numbered.join(rarest, "__no", "left").withColumn("filed", F.explode(
        F.when(F.col("rarest").isNotNull(), F.array("rarest")).when(F.col("namespaces").isNotNull(), by_namespace).otherwise(F.array(anywhere))))
    index = filed.groupBy(F.col("filed.key").alias("__key"), F.col("filed.value").alias("__value")).agg(
        F.collect_list(F.struct("monitor", "wanted", "namespaces")).alias("__monitors"))

    keys = F.concat(F.transform(F.map_entries("__own"), lambda e: pair(e["key"], e["value"])), F.array(anywhere))
    if not labels or "namespace" in labels:  # an absent namespace is the empty one
        keys = F.when(F.col("__own")["namespace"].isNull(), F.concat(keys, F.array(pair(F.lit("namespace"), F.lit(""))))).otherwise(keys)
    spread = rows.withColumn("__pair", F.explode(keys)).select(*rows.columns, F.col("__pair.key").alias("__key"), F.col("__pair.value").alias("__value"))
    met = attach(spread, index, ["__key", "__value"], "inner", slices).withColumn("__m", F.explode("__monitors"))
    holds = F.forall(F.map_entries("__m.wanted"), lambda e: F.coalesce(F.col("__own")[e["key"]], F.lit("")) == e["value"])
    placed = F.col("__m.namespaces").isNull() | F.array_contains("__m.namespaces", F.coalesce(F.col("__own")["namespace"], F.lit("")))
    return met.where(holds & placed).select(*targets.columns, F.col("__m.monitor").alias("monitor"))


def apply_target_settings(samples: DataFrame, settings: DataFrame, target: str = "target",
                          slices: int | None = None) -> DataFrame:
    """Drop samples of disabled targets and metrics outside a keep-list; add the interval.

    An empty keep-list keeps everything. ``settings`` has one row per target kind.
    """
    enabled = settings.where("enabled").select(target, "keep_list", "scrape_interval")
    kept = F.coalesce("keep_list", F.lit("")) == ""
    wanted = F.expr("name rlike concat('^(?:', keep_list, ')$')")
    return attach(samples, enabled, [target], "inner", slices).where(kept | wanted).drop("keep_list")
