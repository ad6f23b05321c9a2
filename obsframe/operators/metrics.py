"""Time series: selection, instant values, counter increases, rollups.

A sample row has ``name``, label columns, ``ts`` and ``value``. ``series`` names the
columns which together identify one series.
"""

from __future__ import annotations

from datetime import datetime, timezone
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.labels import label, label_is
from obsframe.functions.text import full_match
from obsframe.functions.units import interval, parse_duration
from obsframe.plans.slices import lookup_join, scan, settle


def select_series(samples: DataFrame, name: str, **equal: str) -> DataFrame:
    """Samples of one metric whose labels have the given values."""
    out = samples.where(F.col("name") == name)
    for key, value in equal.items():
        out = out.where(label_is(samples, key, value))
    return out


def select_regex(samples: DataFrame, key: str, pattern: str) -> DataFrame:
    """Samples whose label matches the whole pattern; ``__name__`` is the metric name."""
    column = F.col("name") if key == "__name__" else label(samples, key)
    return samples.where(full_match(column, pattern))


def attach_labels(samples: DataFrame, job: str, **fixed: str) -> DataFrame:
    """Add ``job`` and static labels to the label map of every sample."""
    extra = {"job": job, **fixed}
    return samples.withColumn("labels", F.map_concat(
        F.map_filter("labels", lambda k, _: ~k.isin(*extra)),
        F.create_map(*[F.lit(x) for pair in extra.items() for x in pair])))


def instant(samples: DataFrame, series: list[str], at: str, lookback: str) -> DataFrame:
    """Last sample of each series in ``(at - lookback, at]``. One partial aggregate, no sort."""
    return _between(samples, at, lookback).groupBy(*series).agg(
        F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def count_by(samples: DataFrame, series: list[str], at: str, lookback: str, by: str) -> DataFrame:
    """How many series are alive at an instant, per label value."""
    alive = _between(samples, at, lookback).select(*series).distinct()
    return alive.groupBy(by).agg(F.count(F.lit(1)).alias("series"))


def with_deltas(samples: DataFrame, series: list[str], slices: int | None = None) -> DataFrame:
    """Add ``prev_ts``, ``prev_value`` and the reset-aware ``delta`` to each sample."""
    out = scan(samples, series, ["ts"], slices=slices,
               previous={"prev_ts": F.col("ts"), "prev_value": F.col("value")})
    grown = F.when(F.col("value") >= F.col("prev_value"), F.col("value") - F.col("prev_value"))
    return out.withColumn("delta", F.when(F.col("prev_ts").isNotNull(), F.coalesce(grown, F.col("value"))))


def increase(samples: DataFrame, series: list[str], at: str, range_: str, mode: str = "raw",
             slices: int | None = None) -> DataFrame:
    """Growth of each counter over ``(at - range, at]``.

    ``raw`` sums the deltas, counting the step from the last sample before the range.
    ``extrapolated`` uses only the samples inside and stretches to the range edges.
    """
    inside = _between(samples, at, range_).select(*series, "ts", "value")
    if mode == "raw":
        # Of the history before the range only each series' last sample is needed.
        earlier = samples.where(F.col("ts") <= _start(samples, at, range_)).groupBy(*series).agg(
            F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
        steps = with_deltas(inside.unionByName(earlier), series, slices)
        return (steps.where(F.col("ts") > _start(samples, at, range_)).groupBy(*series)
                .agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase")))
    if mode != "extrapolated":
        raise ValueError(f"unknown mode {mode!r}")
    steps = with_deltas(inside, series, slices)
    ends = _seconds(_moment(samples, at)), parse_duration(range_).total_seconds()
    return _stretched(steps, series, ends[0] - ends[1], ends[0])


def increase_grid(samples: DataFrame, series: list[str], every: str, range_: str | None = None,
                  slices: int | None = None) -> DataFrame:
    """Raw growth in every window ``[start, start + range)`` that holds a sample, one window per ``every``.

    Where windows overlap, steps are first summed into panes, and a window's growth follows from running sums over the moments
    at which a pane enters the sliding range and leaves it. So rows are not copied into each window they lie in.
    """
    steps = with_deltas(samples.select(*series, "ts", "value"), series, slices)
    width, stride = (round(parse_duration(d).total_seconds() * 1_000_000) for d in (range_ or every, every))
    if width == stride:
        return (steps.groupBy(F.window("ts", interval(range_ or every), interval(every)).alias("w"), *series)
                .agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase"))
                .select(F.col("w.start").alias("start"), *series, "increase"))
    pane = gcd(width, stride)
    epoch = F.lit("1970-01-01 00:00:00").cast(samples.schema["ts"].dataType)
    at = F.floor(F.timestamp_diff("MICROSECOND", epoch, F.col("ts")) / F.lit(pane))
    panes = steps.groupBy(*series, at.alias("pane")).agg(
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("grown"), F.count(F.lit(1)).alias("n"))
    inside, apart = width // pane, stride // pane
    enters = F.ceil((F.col("pane") - (inside - 1)) / F.lit(apart)) * apart
    leaves = (F.floor(F.col("pane") / F.lit(apart)) + 1) * apart
    edges = F.array(F.struct(enters.alias("first"), F.col("grown"), F.col("n")),
                    F.struct(leaves.alias("first"), (-F.col("grown")).alias("grown"), (-F.col("n")).alias("n")))
    moves = panes.select(*series, F.explode(edges).alias("e")).groupBy(*series, F.col("e.first").alias("first")).agg(
        F.sum("e.grown").alias("grown"), F.sum("e.n").alias("n"))
    moves = settle(moves, slices)
    held = scan(moves, series, ["first"], sums={"increase": F.col("grown"), "samples": F.col("n")},
                following={"until": F.col("first")}, slices=slices).where("samples > 0")
    starts = F.explode(F.sequence("first", F.col("until") - apart, F.lit(apart).cast("long")))
    return held.select(*series, "increase", starts.alias("at")).select(
        F.timestamp_add("MICROSECOND", F.col("at") * pane, epoch).alias("start"), *series, "increase")


def sum_by(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(value))


def rollup(samples: DataFrame, by: list[str], every: str = "PT15M", span: str | None = None,
           at: str | None = None) -> DataFrame:
    """Average, minimum, maximum, total and count per window, over ``span`` up to ``at``."""
    rows = _between(samples, at, span) if at and span else samples
    return (rows.groupBy(F.window("ts", interval(every)).alias("w"), *by)
            .agg(F.avg("value").alias("average"), F.min("value").alias("minimum"),
                 F.max("value").alias("maximum"), F.sum("value").alias("total"),
                 F.count("value").alias("count"))
            .select(F.col("w.start").alias("start"), *by, "average", "minimum", "maximum", "total", "count"))


def error_rate(requests: DataFrame, every: str, status: str = "status", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of 4xx and 5xx answers per window."""
    bad = F.count_if(F.col(status).between(400, 599))
    return (requests.groupBy(F.window("ts", interval(every)).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("requests"), bad.alias("errors"),
                 (bad / F.count(F.lit(1))).alias("error_rate"))
            .select(F.col("w.start").alias("start"), *by, "requests", "errors", "error_rate"))


def status_counts(probes: DataFrame, status: str = "status") -> DataFrame:
    return probes.groupBy(status).agg(F.count(F.lit(1)).alias("probes"))


def target_up(scrapes: DataFrame, targets: DataFrame, key: str, every: str, first: str, last: str) -> DataFrame:
    """1 where a target reported within a scrape slot, else 0, for every slot and target.

    Slots start at ``first`` and follow each other by ``every``; the one that starts last starts at ``last`` at most.
    """
    width = F.expr(f"interval {interval(every)}")
    kind = scrapes.schema["ts"].dataType
    begin, end = F.lit(first).cast(kind), F.lit(last).cast(kind)
    grid = targets.select(key).distinct().withColumn("slot", F.explode(F.sequence(begin, end, width)))
    millis = round(parse_duration(every).total_seconds() * 1000)
    offset = round(datetime.fromisoformat(first).replace(tzinfo=timezone.utc).timestamp() * 1000) % millis
    inside = scrapes.where((F.col("ts") >= begin) & (F.col("ts") < end + width))
    slot = F.window("ts", interval(every), interval(every), f"{offset} milliseconds").start
    seen = inside.groupBy(key, slot.alias("slot")).agg(F.lit(1).alias("seen"))
    return lookup_join(grid, seen, [key, "slot"]).select(key, "slot", F.coalesce("seen", F.lit(0)).alias("up"))


def _moment(samples: DataFrame, at: str) -> Column:
    return F.lit(at).cast(samples.schema["ts"].dataType)


def _start(samples: DataFrame, at: str, span: str) -> Column:
    return _moment(samples, at) - F.expr(f"interval {interval(span)}")


def _between(samples: DataFrame, at: str, span: str) -> DataFrame:
    return samples.where((F.col("ts") > _start(samples, at, span)) & (F.col("ts") <= _moment(samples, at)))


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _stretched(steps: DataFrame, series: list[str], start: Column, end: Column) -> DataFrame:
    """Scale the growth between first and last sample to the edges of the range.

    An edge within 1.1 average gaps is reached fully, a farther one by half a gap, and
    the start never goes below the point where the counter would have been zero.
    """
    spans = steps.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("grown"),
        F.min_by("value", "ts").alias("first_value"),
        _seconds(F.min("ts")).alias("t0"), _seconds(F.max("ts")).alias("t1"),
    ).where(F.col("n") >= 2)
    sampled = F.col("t1") - F.col("t0")
    gap = sampled / (F.col("n") - 1)
    spans = spans.withColumns({"sampled": sampled, "gap": gap, "lead": F.col("t0") - start, "tail": end - F.col("t1")})
    far = F.col("gap") * 1.1
    to_zero = F.try_divide(F.col("sampled") * F.col("first_value"), F.col("grown"))
    lead = F.when(F.col("lead") >= far, F.col("gap") / 2).otherwise(F.col("lead"))
    lead = F.when((F.col("grown") > 0) & (F.col("first_value") >= 0) & (to_zero < lead), to_zero).otherwise(lead)
    tail = F.when(F.col("tail") >= far, F.col("gap") / 2).otherwise(F.col("tail"))
    stretched = F.try_divide(F.col("grown") * (F.col("sampled") + lead + tail), F.col("sampled"))
    return spans.select(*series, stretched.alias("increase"))
