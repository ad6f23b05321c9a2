"""Ordered work over groups of any size.

A window such as ``lag`` or a running sum puts a whole key into one task. When one key
holds a third of 100 TB that task never ends. The functions here find the hot keys, cut
their order column into slices of nearly equal row counts, work inside ``(key, slice)``,
and carry a small summary from slice to slice. A group then holds at most about
rows / slices, however skewed the keys are. Other keys stay whole, so a table without
hot keys keeps the ordinary plan.

How many slices are wanted follows from the plan's own size estimate; small inputs need
none. ``spark.obsframe.slices`` or the ``slices`` argument overrides the estimate.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from obsframe.session import write_once

SLICE = "__slice"
EDGE = "__edge"
PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
SLICE_BYTES = 128 * 1024 * 1024
WHOLE_BYTES = 8 * 1024 * 1024  # without keys no slice is spared: all rows go into one task or into slices
MOST_SLICES = 16384
SAMPLED_BYTES = 8 * SLICE_BYTES  # tables from this size on are sampled for their cuts
SAMPLE_PER_SLICE = 640_000  # bytes of input
UNKNOWN_BYTES = 2**60
TEXT_BYTES = 6  # bytes of a text that fit a double beside their number
FIRST, LAST = -1e308, 1e308  # places of null and of NaN; infinite values lie right inside
FIXED_ZONES = ("UTC", "Etc/UTC", "GMT", "Z")  # no clock changes, so a cast keeps the order


def slice_count(df: DataFrame, slices: int | None = None, size_each: int = SLICE_BYTES) -> int:
    """Slices wanted for ``df``: the argument, the session's setting, or by size."""
    spark = df.sparkSession
    fixed = slices or spark.conf.get("spark.obsframe.slices", None)
    if fixed:
        return int(fixed)
    size = _size(df)
    if size >= UNKNOWN_BYTES:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(ceil(size / size_each), MOST_SLICES))


def _size(df: DataFrame) -> int:
    """Bytes the plan is thought to read; a join's estimate alone would be a product."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    return min(_bytes(plan), sum(_bytes(leaves.apply(i)) for i in range(leaves.size())))


def _bytes(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def slice_by(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Add the slice column if some key is hot: 0 for other keys, from 1 up for hot ones.

    Without keys the whole table is one hot group. Cuts are quantiles of the first order
    column, as a double. Rows that tie there, so many that they span several slices, are
    cut further by what the double left out: the rest of a whole number, the next bytes of
    a text. Only rows whose values are equal are cut by the next order column. Hot keys and cuts are few, found
    by small jobs, and become constants of the plan, so a re-run task sees the same slices.
    """
    if SLICE in df.columns:
        return df
    count = slice_count(df, slices, SLICE_BYTES if keys else WHOLE_BYTES)
    if count == 1:
        return df
    rows = df
    if keys:
        hot = _hot_keys(df, keys, count)
        if hot is None:
            return df
        rows = _match(df, F.broadcast(hot), keys)
    is_hot = F.col("__parts").isNotNull() if keys else F.lit(True)
    cut, tied, stride = rows.withColumn(SLICE, F.lit(0).cast("long")), is_hot, 1
    for column in order:
        level = 0
        while True:
            place = F.when(tied, _place(df, column, level))
            cut = cut.withColumn("__place", place)
            cuts = _quantiles(cut, "__place", count)
            common = sorted({c for c, after in zip(cuts, cuts[1:]) if c == after})
            edges = {*cuts, *[nextafter(c, inf) for c in common]}
            if stride * (len(edges) + 1) >= 2**62:
                break  # what is tied by now stays together
            stride *= len(edges) + 1
            cut = _bucket(cut, "__place", edges, "__part")
            part = F.when(tied, F.col("__part")).otherwise(0)
            cut = cut.withColumn(SLICE, F.col(SLICE) * (len(edges) + 1) + part).drop("__part")
            if not common:
                break
            tied = tied & place.isin(common)
            level += 1
            if level >= _levels(cut.where(tied), column):
                break  # rows that are tied now have equal values in this column
        if not common or stride >= 2**61:
            break
    return cut.withColumn(SLICE, F.when(is_hot, F.col(SLICE) + 1).otherwise(0)).drop("__parts", "__place")


def slice_once(df: DataFrame, keys: list[str], order: list[str], slices: int | None) -> tuple[DataFrame, int | None]:
    """``slice_by`` for several scans of one table: the second value goes to each scan."""
    cut = slice_by(df, keys, order, slices)
    return cut, (None if SLICE in cut.columns else 1)


def _hot_keys(df: DataFrame, keys: list[str], count: int) -> DataFrame | None:
    """Keys with more than ``1 / count`` of the rows, of which there are fewer than
    ``count``, and in how many parts each should be cut."""
    seen = Observation()
    sizes = _sampled(df, count).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).observe(seen, F.sum("__n").alias("rows"))
    top = sizes.orderBy(F.desc("__n")).limit(count).collect()
    share = (seen.get["rows"] or 0) / count
    hot = [(*row[:-1], ceil(row["__n"] / share)) for row in top if row["__n"] > share]
    if not hot:
        return None
    kinds = [*[df.schema[k].dataType for k in keys], T.IntegerType()]
    found = F.array(*[F.struct(*[_literal(v, kind).alias(n) for v, kind, n in zip(row, kinds, [*keys, "__parts"])])
                      for row in hot])
    return df.sparkSession.range(1).select(F.inline(found))


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType) and value is not None:
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(kind)


def _sampled(df: DataFrame, count: int) -> DataFrame:
    """Large tables are sampled, as Spark does to range-partition them: only the evenness
    of slices depends on it, never a result."""
    size = _size(df)
    if not SAMPLED_BYTES <= size < UNKNOWN_BYTES:
        return df
    return df.sample(min(1.0, count * SAMPLE_PER_SLICE / size), seed=1)


def _quantiles(df: DataFrame, column: str, count: int) -> list[float]:
    """Ascending cuts into ``count`` parts, a common value as often as it is hit."""
    return sorted(_sampled(df.where(F.col(column).isNotNull()), count).approxQuantile(
        column, [i / count for i in range(1, count)], 0.25 / count))


def _bucket(df: DataFrame, column: str, edges: set[float], name: str) -> DataFrame:
    cut = Bucketizer(splits=[-inf, *sorted(edges), inf], inputCol=column, outputCol=name).transform(
        df.fillna(-inf, column))
    return cut.withColumn(name, F.col(name).cast("int"))


def settle(df: DataFrame, slices: int | None = None, size_each: int = SLICE_BYTES) -> DataFrame:
    """Write a costly intermediate table once, if it will be read in slices (``WHOLE_BYTES`` for a scan without keys).

    Finding cuts, summarizing and the final pass each read their input.
    """
    return df if slice_count(df, slices, size_each) == 1 else write_once(df, "settled")


def unslice(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    highs: dict[str, Column] | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Per row and key, in ascending ``order``: the row before, the row after, running
    sums and maxima up to and including the row, and figures of the whole key.

    ``previous``/``following``/``sums``/``highs`` map a new column to an expression;
    ``totals`` to ``(kind, expression)`` with a kind of ``count``, ``sum``, ``min`` or
    ``max``. ``order`` must be unique within a key.
    """
    previous, following = previous or {}, following or {}
    sums, highs, totals = sums or {}, highs or {}, totals or {}
    cut = slice_by(df, keys, order, slices)
    if SLICE not in cut.columns:
        local = Window.partitionBy(*keys).orderBy(*order)
        upto, whole = local.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
        return cut.withColumns({
            **{n: F.lag(F.struct(c.alias("v"))).over(local)["v"] for n, c in previous.items()},
            **{n: F.lead(F.struct(c.alias("v"))).over(local)["v"] for n, c in following.items()},
            **{n: F.sum(c).over(upto) for n, c in sums.items()},
            **{n: F.max(c).over(upto) for n, c in highs.items()},
            **{n: PARTIAL[kind](c).over(whole) for n, (kind, c) in totals.items()},
        })

    # One small row per (hot key, slice); partial aggregation happens before its shuffle.
    # A single order column keeps it a hash aggregate.
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    parts = {f"__tail_{n}": F.max_by(c, place) for n, c in previous.items()}
    parts |= {f"__head_{n}": F.min_by(c, place) for n, c in following.items()}
    parts |= {f"__sum_{n}": F.sum(c) for n, c in sums.items()}
    parts |= {f"__high_{n}": F.max(c) for n, c in highs.items()}
    parts |= {f"__total_{n}": PARTIAL[kind](c) for n, (kind, c) in totals.items()}
    summary = cut.where(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in parts.items()])

    # What reaches a slice from those before it (and, for ``following``, from those after)
    # becomes an edge row that sorts before (after) the slice's own rows. The windows below
    # then need no join: rows are shuffled once, together with the few edge rows.
    across, whole = Window.partitionBy(*keys).orderBy(SLICE), Window.partitionBy(*keys)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = summary.select(
        *keys, SLICE, F.lit(-1).alias(EDGE),
        *([F.lag(_pack({n: F.col(f"__tail_{n}") for n in previous})).over(across).alias("__tail")] if previous else []),
        *[F.sum(f"__sum_{n}").over(before).alias(f"__sum_{n}") for n in sums],
        *[F.max(f"__high_{n}").over(before).alias(f"__high_{n}") for n in highs],
        *[MERGE[kind](f"__total_{n}").over(whole).alias(f"__total_{n}") for n, (kind, _) in totals.items()])
    rows = cut.withColumn(EDGE, F.lit(0)).unionByName(edges, allowMissingColumns=True)
    if following:
        after = F.lead(_pack({n: F.col(f"__head_{n}") for n in following})).over(across)
        rows = rows.unionByName(summary.select(*keys, SLICE, F.lit(1).alias(EDGE), after.alias("__head")),
                                allowMissingColumns=True)

    local = Window.partitionBy(*keys, SLICE).orderBy(EDGE, *order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy(*keys, SLICE)
    own = F.col(EDGE) == 0
    found = rows.withColumns({
        **({"__prev": F.lag(F.when(own, _pack(previous)).otherwise(F.col("__tail"))).over(local)} if previous else {}),
        **({"__next": F.lead(F.when(own, _pack(following)).otherwise(F.col("__head"))).over(local)} if following else {}),
        **{f"__run_{n}": F.sum(F.when(own, c).otherwise(F.col(f"__sum_{n}"))).over(upto) for n, c in sums.items()},
        **{f"__top_{n}": F.max(F.when(own, c).otherwise(F.col(f"__high_{n}"))).over(upto) for n, c in highs.items()},
        **{f"__all_{n}": F.coalesce(F.max(f"__total_{n}").over(inside), PARTIAL[kind](F.when(own, c)).over(inside))
           for n, (kind, c) in totals.items()},
    })
    return found.where(own).select(
        *df.columns,
        *[F.col("__prev")[n].alias(n) for n in previous],
        *[F.col("__next")[n].alias(n) for n in following],
        *[F.col(f"__run_{n}").alias(n) for n in sums],
        *[F.col(f"__top_{n}").alias(n) for n in highs],
        *[F.col(f"__all_{n}").alias(n) for n in totals])


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
           slices: int | None = None) -> DataFrame:
    """Join ``lookup``, unique per key, onto ``df`` whose keys may be very skewed.

    A lookup that Spark's own size check lets it broadcast needs nothing else. Beyond
    that, rows of hot keys are salted by a hash of their content, and the lookup rows of
    those keys, fewer than the slices wanted, are repeated once per salt.
    """
    count = slice_count(df, slices)
    if count == 1 or (slices is None and _broadcastable(lookup)):
        return _match(df, lookup, keys, how)
    hot = _hot_keys(df, keys, count)
    if hot is None:
        return _match(df, lookup, keys, how)
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*hashable), F.col("__parts")).cast("int") + 1)
    salted = _match(df, F.broadcast(hot), keys).withColumn("__salt", F.coalesce(salt, F.lit(0))).drop("__parts")
    repeated = _match(lookup, F.broadcast(hot), keys, "inner").withColumn(
        "__salt", F.explode(F.sequence(F.lit(1), F.col("__parts")))).drop("__parts")
    given = lookup.withColumn("__salt", F.lit(0)).unionByName(repeated)
    return _match(salted, given, [*keys, "__salt"], how).drop("__salt")


def _broadcastable(df: DataFrame) -> bool:
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= _bytes(df._jdf.queryExecution().optimizedPlan()) <= limit


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int, value: Column,
              name: str, slices: int | None = None) -> DataFrame:
    """Add an array of ``value`` from up to ``n`` rows before each row, oldest first."""
    cut = slice_by(df, keys, order, slices)
    if SLICE not in cut.columns:
        local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
        return cut.withColumn(name, F.collect_list(F.struct(value.alias("v"))).over(local)["v"])
    backwards = Window.partitionBy(*keys, SLICE).orderBy(*[F.desc(o) for o in order])
    ends = (
        cut.where(F.col(SLICE) > 0)
        .select(*keys, SLICE, value.alias("v"), F.row_number().over(backwards).alias("back")).where(F.col("back") <= n)
        .groupBy(*keys, SLICE).agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("b"), "v"))).alias("end")))
    across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(-n, -1)
    earlier = F.flatten(F.collect_list("end").over(across))
    carried = ends.select(*keys, SLICE, earlier.alias("all")).select(
        *keys, SLICE, F.posexplode(F.slice("all", F.greatest(F.size("all") - n, F.lit(0)) + 1, n)).alias("at", "e"))
    edges = carried.select(*keys, SLICE, (F.col("at") - n).alias(EDGE), F.col("e.v").alias("__carried"))
    rows = cut.withColumn(EDGE, F.lit(0)).unionByName(edges, allowMissingColumns=True)
    local = Window.partitionBy(*keys, SLICE).orderBy(EDGE, *order).rowsBetween(-n, -1)
    given = F.when(F.col(EDGE) == 0, value).otherwise(F.col("__carried"))
    found = rows.withColumn(name, F.collect_list(F.struct(given.alias("v"))).over(local)["v"])
    return found.where(F.col(EDGE) == 0).select(*df.columns, name)


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float],
                slices: int | None = None) -> DataFrame:
    """Exact interpolated percentiles per key, nulls left out.

    The built-in exact aggregate holds every distinct value of a group in memory, which
    is fine for all but hot keys. Of those, only counts travel first; then just the
    slices that contain a wanted rank are ordered.
    """
    known = df.select(*keys, value).where(F.col(value).isNotNull())
    cut = slice_by(known, keys, [value], slices)
    built_in = [F.percentile(value, p).alias(n) for n, p in wanted.items()]
    if SLICE not in cut.columns:
        return cut.groupBy(*keys).agg(*built_in)
    others, cut = cut.where(F.col(SLICE) == 0), cut.where(F.col(SLICE) > 0)

    counts = cut.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("__n"))
    across = Window.partitionBy(*keys).orderBy(SLICE)
    counts = counts.select(
        *keys, SLICE, "__n",
        (F.sum("__n").over(across) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"))
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), edge.cast("long").alias("rank"), (spot - F.floor(spot)).alias("part"))
        for name, p in wanted.items()
        for spot in [(F.col("__all") - 1) * F.lit(float(p))]
        for edge in (F.floor(spot), F.ceil(spot))
    ])
    places = counts.withColumn("__hit", F.filter(
        F.array_distinct(ranks), lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__before") + F.col("__n")),
    )).where(F.size("__hit") > 0)
    inside = _match(cut, places.select(*keys, SLICE, "__before", "__hit"), [*keys, SLICE], "inner")
    # Equal values are counted, not listed, so one very common value stays one row.
    values = inside.groupBy(*keys, SLICE, "__before", "__hit", value).agg(F.count(F.lit(1)).alias("__same"))
    last = F.col("__before") + F.sum("__same").over(Window.partitionBy(*keys, SLICE).orderBy(value))
    found = (
        values.withColumn("__last", last)
        .withColumn("__hit", F.explode(F.filter("__hit", lambda r: (
            r["rank"] < F.col("__last")) & (r["rank"] >= F.col("__last") - F.col("__same")))))
        .groupBy(*keys, F.col("__hit.name").alias("__name"))
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max("__hit.part").alias("part"))
        .withColumn("__value", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    )
    hot = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__name") == n, F.col("__value"))).alias(n) for n in wanted])
    return hot.unionByName(others.groupBy(*keys).agg(*built_in)) if keys else hot


def summarize(df: DataFrame, keys: list[str], figures: list[Column], value: str, wanted: dict[str, float],
              slices: int | None = None) -> DataFrame:
    """Aggregates per key together with exact percentiles of ``value``."""
    slices = slice_count(df, slices)
    if slices == 1:
        return df.groupBy(*keys).agg(*figures, *[F.percentile(value, p).alias(n) for n, p in wanted.items()])
    return _match(df.groupBy(*keys).agg(*figures), percentiles(df, keys, value, wanted, slices), keys)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join keeping the left key columns."""
    return _match(left, right, keys, how)


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _pack(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _place(df: DataFrame, name: str, level: int = 0) -> Column:
    """A finite double that never falls as ``name`` rises among rows that are equal in all lower levels; nulls come first."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        spot = F.unix_micros(column)
    elif isinstance(kind, T.TimestampNTZType) and df.sparkSession.conf.get("spark.sql.session.timeZone") in FIXED_ZONES:
        spot = F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(column.cast("date")) * 86400.0
        spot = day + F.hour(column) * 3600 + F.minute(column) * 60 + F.date_part(F.lit("SECOND"), column)
    elif isinstance(kind, T.DateType):
        spot = F.unix_date(column)
    elif isinstance(kind, T.StringType):
        part = F.substring(F.encode(column, "UTF-8"), level * TEXT_BYTES + 1, TEXT_BYTES)
        # a byte more than its value, so that an end comes before any byte
        spot = F.conv(F.rpad(F.hex(part), 2 * TEXT_BYTES, "0"), 16, 10).cast("double") * 8 + F.octet_length(part)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = F.when(F.abs(column) < inf, column.cast("double") + 0.0)  # no negative zero
        edge = F.when(F.isnan(column), LAST).when(column > 0, LAST * 0.95).otherwise(FIRST * 0.95)
        spot = F.coalesce(finite if level else finite / 2, F.lit(0.0) if level else edge)
    elif level:  # what the nearest double leaves of the whole part, then the fraction, then what its double leaves
        part, exact = (F.floor(column), "decimal(38,0)") if level == 1 else (F.pmod(column, F.lit(1)), kind.simpleString())
        whole = part.cast(exact)
        spot = whole if level == 2 else F.try_subtract(whole, (column if level == 1 else part).cast("double").try_cast(exact))
    else:
        spot = column
    spot = spot.cast("double")
    return F.when(column.isNull(), F.lit(FIRST)).otherwise(spot)


def _levels(tied: DataFrame, name: str) -> int:
    """Levels after which rows that still tie are equal."""
    kind = tied.schema[name].dataType
    if isinstance(kind, T.StringType):
        longest = tied.agg(F.max(F.octet_length(name))).first()[0] or 0
        return max(1, ceil(longest / TEXT_BYTES))
    return 4 if isinstance(kind, T.DecimalType) else 2 if isinstance(kind, (T.LongType, T.DoubleType, T.FloatType)) else 1
