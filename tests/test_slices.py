"""Sliced plans against plain Python, on keys and order values of extreme skew."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.plans.slices import SLICE, attach, last_rows, percentiles, scan, slice_by, slice_count


def skewed(n=900, seed=1):
    """A third of the rows have one key, some keys are null, places have gaps."""
    rng = random.Random(seed)
    places = rng.sample(range(10 * n), n)
    return [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", p, rng.randrange(100))
            for i, p in enumerate(places)]


@pytest.fixture(scope="module")
def data():
    return skewed()


@pytest.fixture
def frame(spark, data):
    return spark.createDataFrame(data, "k string, p long, v long")


def by_key(data):
    groups = {}
    for k, p, v in sorted(data, key=lambda r: r[1]):
        groups.setdefault(k, []).append((p, v))
    return groups


@pytest.mark.parametrize("slices", [1, 2, 7, 40])
def test_scan(frame, data, slices):
    out = scan(frame, ["k"], ["p"], slices=slices, previous={"prev": F.col("v")}, following={"next": F.col("v")},
               sums={"run": F.col("v"), "rn": F.lit(1)}, highs={"top": F.col("v")},
               totals={"n": ("count", F.lit(1)), "low": ("min", F.col("v")), "all": ("sum", F.col("v"))})
    got = {r.p: (r.k, r.prev, r.next, r.run, r.rn, r.top, r.n, r.low, r.all) for r in out.collect()}
    want = {}
    for k, items in by_key(data).items():
        values = [v for _, v in items]
        for i, (p, _) in enumerate(items):
            want[p] = (k, values[i - 1] if i else None, values[i + 1] if i + 1 < len(values) else None,
                       sum(values[:i + 1]), i + 1, max(values[:i + 1]), len(values), min(values), sum(values))
    assert got == want
    assert SLICE not in out.columns


@pytest.mark.parametrize("slices", [1, 9])
def test_scan_without_keys(frame, data, slices):
    got = {r.p: (r.rn, r.n) for r in scan(frame, [], ["p"], sums={"rn": F.lit(1)},
                                          totals={"n": ("count", F.lit(1))}, slices=slices).collect()}
    assert got == {p: (i + 1, len(data)) for i, p in enumerate(sorted(p for _, p, _ in data))}


def test_previous_keeps_null_values_apart_from_missing_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, 7)], "k string, p int, v int")
    for slices in (1, 4):
        out = scan(df, ["k"], ["p"], previous={"prev": F.col("v"), "seen": F.lit(True)}, slices=slices)
        assert {r.p: (r.prev, r.seen) for r in out.collect()} == {
            1: (None, None), 2: (None, True), 3: (5, True), 4: (None, True)}


@pytest.mark.parametrize("slices", [1, 3, 60])
def test_last_rows(frame, data, slices):
    out = last_rows(frame, ["k"], ["p"], 4, F.col("v"), "before", slices)
    got = {r.p: list(r.before or []) for r in out.collect()}
    want = {p: [v for _, v in items[max(0, i - 4):i]] for items in by_key(data).values() for i, (p, _) in enumerate(items)}
    assert got == want


@pytest.mark.parametrize("slices", [1, 5, 30])
def test_percentiles_are_exact(frame, data, slices):
    got = {r.k: (r.mid, r.p90) for r in percentiles(frame, ["k"], "v", {"mid": 0.5, "p90": 0.9}, slices).collect()}
    for k, items in by_key(data).items():
        values = sorted(v for _, v in items)
        spot = 0.9 * (len(values) - 1)
        low = values[int(spot)]
        high = values[min(int(spot) + 1, len(values) - 1)]
        assert got[k][0] == statistics.median(values)
        assert got[k][1] == pytest.approx(low + (high - low) * (spot - int(spot)))


def test_percentiles_leave_nulls_out(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    for slices in (1, 3):
        got = {r.k: r.mid for r in percentiles(df, ["k"], "v", {"mid": 0.5}, slices).collect()}
        assert got["a"] == 2.0 and got.get("b") is None


def test_attach(frame, data, spark):
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, w int")
    for slices in (1, 16):
        for how in ("left", "inner"):
            out = attach(frame, lookup, ["k"], how, slices)
            got = sorted(((r.p, r.w) for r in out.collect()))
            known = {"hot": 1, "k1": 2}
            assert got == sorted((p, known.get(k)) for k, p, _ in data if how == "left" or k in known)


def test_no_slice_of_a_hot_key_is_large(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("k"),
        F.pow(F.col("id"), 3).alias("p"))
    cut = slice_by(rows, ["k"], ["p"], 20)
    sizes = cut.groupBy("k", SLICE).count()
    assert {r.k for r in cut.where(F.col(SLICE) > 0).select("k").distinct().collect()} == {"hot"}
    assert sizes.agg(F.max("count")).first()[0] < 60_000 / 20 * 1.6


def test_common_order_values_are_cut_by_the_second_column(spark):
    rows = spark.range(40_000).select(
        F.lit("one").alias("k"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("p"), F.col("id").alias("q"))
    cut = slice_by(rows, ["k"], ["p", "q"], 20)
    assert cut.groupBy(SLICE).count().agg(F.max("count")).first()[0] < 40_000 / 20 * 1.6
    edges = cut.groupBy(SLICE).agg(F.min(F.struct("p", "q")).alias("lo"), F.max(F.struct("p", "q")).alias("hi")).orderBy(SLICE).collect()
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string", "double"])
def test_slices_follow_the_order_of_every_type(spark, kind):
    n = F.col("id")
    value = {"timestamp": F.timestamp_micros(n * 3_700_000_123), "timestamp_ntz": F.timestamp_micros(n * 3_700_000_123).cast("timestamp_ntz"),
             "date": F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")), "string": F.md5(n.cast("string")),
             "double": n / 3 - 100}[kind]
    rows = spark.range(500).select(F.when(n != 250, value).alias("p"), n.alias("q"))
    edges = (slice_by(rows, [], ["p", "q"], 8).groupBy(SLICE)
             .agg(F.min(F.struct("p", "q")).alias("lo"), F.max(F.struct("p", "q")).alias("hi"))
             .withColumn("after", F.lead("lo").over(Window.orderBy(SLICE))))
    assert edges.where(F.col("after") <= F.col("hi")).count() == 0
    assert edges.count() >= 7


def test_slice_count_follows_size(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    assert slice_count(spark.read.parquet(path)) == 1
    assert slice_count(spark.read.parquet(path), 6) == 6


def test_a_table_without_keys_is_cut_long_before_its_rows_fill_a_task(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3_000_000).selectExpr("xxhash64(id) at", "1 step").write.parquet(path)
    rows = spark.read.parquet(path)
    parts = slice_by(rows, [], ["at"]).groupBy(SLICE).count().agg(F.max("count"), F.count("count")).first()
    assert parts[1] >= 3 and parts[0] <= 1_300_000
    assert SLICE not in slice_by(rows, ["step"], ["at"]).columns
    last = scan(rows, [], ["at"], sums={"live": F.col("step")}).orderBy(F.desc("at")).first()
    assert last["live"] == 3_000_000


def test_without_hot_keys_the_plan_stays_plain(spark):
    rows = spark.range(1000).selectExpr("id % 100 k", "id p")
    assert SLICE not in slice_by(rows, ["k"], ["p"], 20).columns
    plan = scan(rows, ["k"], ["p"], sums={"rn": F.lit(1)}, slices=20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Union" not in plan
    assert "Union" not in attach(rows, rows.select("k").distinct(), ["k"], "left", 20)._jdf.queryExecution().executedPlan().toString()


def test_sliced_scan_shuffles_rows_once_and_joins_nothing_large(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) k", "id p", "id v").write.parquet(path)
    out = scan(spark.read.parquet(path), ["k"], ["p"], previous={"prev": F.col("v")}, sums={"rn": F.lit(1)}, slices=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Union" in plan


def test_nan_comes_last_and_null_first(spark):
    values = [None, float("nan"), float("-inf"), -1.0, 2.0, 3.0, float("inf")]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values * 3)], "p double, q int")
    got = [scan(rows, [], ["p", "q"], sums={"rn": F.lit(1)}, slices=n).orderBy("q").select("rn").collect() for n in (1, 4)]
    assert got[0] == got[1]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "decimal(10,2)", "boolean", "binary", "double"])
def test_hot_keys_of_every_type_are_found(spark, kind):
    value = {"boolean": "id % 2 = 0", "binary": "encode(if(id % 2 = 0, 'x', 'y' || id), 'utf-8')"}.get(
        kind, f"cast(cast(if(id % 2 = 0, 0, id * 86400) as {'timestamp' if kind[0] in 'td' and kind[:3] in ('tim', 'dat') else kind}) as {kind})")
    rows = spark.range(400).selectExpr(f"{value} k", "id p")
    cut = slice_by(rows, ["k"], ["p"], 10)
    hot = cut.where(F.col(SLICE) > 0).groupBy("k").count().collect()
    assert [r["count"] for r in hot][:1] == [200]
    assert cut.groupBy("k", SLICE).count().agg(F.max("count")).first()[0] <= 45
    assert slice_count(cut) == 1 or slice_count(cut, 3) == 3


def test_sampled_cuts_are_even_and_change_no_result(spark, data, monkeypatch):
    from obsframe.plans import slices
    rows = spark.range(200_000).selectExpr("if(id % 3 = 0, 0, id) k", "id p")
    monkeypatch.setattr(slices, "SAMPLED_BYTES", 0)
    monkeypatch.setattr(slices, "SAMPLE_PER_SLICE", 20_000)
    cut = slice_by(rows, ["k"], ["p"], 10)
    hot = cut.where(F.col(SLICE) > 0)
    assert hot.select("k").distinct().count() == 1
    assert hot.groupBy(SLICE).count().agg(F.max("count")).first()[0] < 66_667 / 10 * 1.5
    wrong = scan(rows, ["k"], ["p"], sums={"rn": F.lit(1)}, slices=10).where("k = 0 and rn <> p div 3 + 1")
    assert wrong.count() == 0


def _orders():
    """Values that a double cannot tell apart, as (type, values in ascending order)."""
    big = 2**53
    return {
        "prefix": ("string", [f"service-{c}{d}" for c in "abc" for d in ("", "x", "y")]),
        "ends": ("string", ["", "a", "a\x00", "aaaaaa", "aaaaaaa", "aaaaaab", "é", "漢字漢字漢字", "漢字漢字漢字漢"]),
        "wide": ("bigint", [-big - 1, -big, 0, big, big + 1, big + 2, big + 3, 2**62, 2**62 + 1]),
        "decimal": ("decimal(38,10)", [f"12345678901234567890.{d:010d}" for d in range(9)]),
    }


@pytest.mark.parametrize("kind", sorted(_orders()))
@pytest.mark.parametrize("slices", [4, 12, 40])
def test_order_that_a_double_cannot_hold(spark, kind, slices):
    sql, values = _orders()[kind]
    rng = random.Random(slices)
    rows = [("hot" if rng.random() < 0.9 else f"k{i % 7}", str(v), i) for i, v in enumerate(rng.choices(values, k=700))]
    df = spark.createDataFrame(rows, "k string, s string, id long").withColumn("o", F.col("s").cast(sql))
    got = {r.id: r.rn for r in scan(df, ["k"], ["o", "id"], sums={"rn": F.lit(1)}, slices=slices).collect()}
    place = {str(v): n for n, v in enumerate(values)}
    counts, want = {}, {}
    for k, s, i in sorted(rows, key=lambda r: (r[0], place[r[1]], r[2])):
        counts[k] = want[i] = counts.get(k, 0) + 1
    assert got == want
    sizes = [r["count"] for r in slice_by(df, ["k"], ["o", "id"], slices).where(F.col(SLICE) > 0).groupBy(SLICE).count().collect()]
    assert max(sizes) <= 4 * 700 / slices + 20


@pytest.mark.parametrize("slices", [4, 40])
@pytest.mark.parametrize("places", [
    [None], [float("nan")], [0.0, -0.0, 5e-324, 1e-323],
    [None, float("-inf"), -1.7e308, -1.2e308, 0.0, 1.2e308, 1.7e308, float("inf"), float("nan")]])
def test_order_values_without_a_finite_place(spark, slices, places):
    rows = [("hot" if i % 4 else "cold", places[i % len(places)], None if i % 7 == 0 else i % 5, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, p double, q long, id long")
    got = scan(df, ["k"], ["p", "q", "id"], sums={"rn": F.lit(1)}, previous={"before": F.col("id")}, slices=slices)
    plain = Window.partitionBy("k").orderBy("p", "q", "id")
    want = df.select("id", F.row_number().over(plain).alias("rn"), F.lag("id").over(plain).alias("before"))
    assert {r.id: (r.rn, r.before) for r in got.collect()} == {r.id: (r.rn, r.before) for r in want.collect()}
    sizes = [r["count"] for r in slice_by(df, ["k"], ["p", "q", "id"], slices).where(f"{SLICE} > 0").groupBy("k", SLICE).count().collect()]
    assert max(sizes) <= 3 * 400 / slices


@pytest.mark.parametrize("slices", [4, 12])
def test_versions_at_one_moment_and_null_orders(spark, slices):
    from obsframe.operators.agents import state_as_of, state_versions
    moment = F.lit("2024-01-01").cast("timestamp")
    asked = spark.range(60).select(F.lit("u").alias("k"), moment.alias("ts"), "id")
    saved = spark.range(1).select(F.lit("u").alias("k"), moment.alias("ts"), F.lit(7).alias("v"))
    got = state_as_of(asked, saved, "k", "ts", ["v"], "id", slices).collect()
    assert len(got) == 60 and {r.v for r in got} == {7}
    rows = spark.range(80).select(F.lit("u").alias("k"), F.lit(None).cast("timestamp").alias("ts"), "id")
    assert sorted((r.version, r.id) for r in state_versions(rows, "k", ["ts", "id"], slices).collect()) == [(i + 1, i) for i in range(80)]
