import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsframe.functions.labels import label, promote
from obsframe.operators import metrics as m
from obsframe.operators import relabel as r

SERIES = ["name", "pod"]
START = datetime(2024, 1, 1)


def samples(spark, points):
    df = spark.createDataFrame([("c", pod, t, float(v)) for pod, t, v in points], "name string, pod string, t string, value double")
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")


def at(second):
    return f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"


@pytest.fixture(params=[1, 3])
def slices(request):
    return request.param


def test_raw_increase_counts_resets_and_the_step_into_the_range(spark, slices):
    df = samples(spark, [("a", at(0), 10), ("a", at(60), 14), ("a", at(120), 3), ("a", at(180), 5), ("b", at(130), 9)])
    got = {x.pod: x.increase for x in m.increase(df, SERIES, at(180), "2m", slices=slices).collect()}
    assert got == {"a": 3 + 2, "b": 0.0}  # 14 -> 3 is a reset, the sample at 60 s lies on the open edge
    got = {x.pod: x.increase for x in m.increase(df, SERIES, at(180), "121s", slices=slices).collect()}
    assert got["a"] == 4 + 3 + 2


def test_extrapolated_increase_reaches_near_edges(spark, slices):
    # Samples each 15 s from 5 s to 50 s, range 0..60 s: both edges are nearer than 1.1 gaps.
    df = samples(spark, [("a", at(5 + 15 * i), 100 + 15 * i) for i in range(4)])
    got = m.increase(df, SERIES, at(60), "1m", "extrapolated", slices).collect()[0].increase
    assert got == pytest.approx(45 * 60 / 45)


def test_extrapolated_increase_goes_half_a_gap_towards_far_edges(spark):
    df = samples(spark, [("a", at(120 + 10 * i), 1000 + i) for i in range(4)])
    got = m.increase(df, SERIES, at(300), "5m", "extrapolated").collect()[0].increase
    assert got == pytest.approx(3 * (30 + 5 + 5) / 30)


def test_extrapolated_increase_stops_at_zero_of_the_counter(spark):
    # Growth 30 in 30 s from value 2: zero lies 2 s before the first sample, the edge 8 s before it.
    df = samples(spark, [("a", at(8), 2), ("a", at(18), 12), ("a", at(28), 22), ("a", at(38), 32)])
    got = m.increase(df, SERIES, at(40), "40s", "extrapolated").collect()[0].increase
    assert got == pytest.approx(30 * (30 + 2 + 2) / 30)


def test_extrapolated_increase_needs_two_samples_and_ignores_the_one_before(spark):
    df = samples(spark, [("a", at(0), 1), ("a", at(100), 9), ("b", at(100), 1), ("b", at(110), 2)])
    got = m.increase(df, SERIES, at(120), "30s", "extrapolated")
    assert [x.pod for x in got.collect()] == ["b"]


def test_extrapolated_increase_of_flat_and_of_doubled_samples(spark):
    df = samples(spark, [("flat", at(10 * i), 5) for i in range(4)] + [("twice", at(10), 1), ("twice", at(10), 1)])
    got = {x.pod: x.increase for x in m.increase(df, SERIES, at(40), "40s", "extrapolated").collect()}
    assert got == {"flat": 0.0, "twice": None}


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        m.increase(samples(spark, [("a", at(0), 1)]), SERIES, at(1), "1m", "guess")


def test_instant_takes_the_last_sample_in_the_lookback(spark):
    df = samples(spark, [("a", at(0), 1), ("a", at(50), 2), ("b", at(0), 3)])
    got = {x.pod: x.value for x in m.instant(df, SERIES, at(60), "1m").collect()}
    assert got == {"a": 2.0}  # the edge of the lookback is open
    assert m.count_by(df, SERIES, at(50), "1m", "name").collect()[0].series == 2


def test_labels_from_map_or_column(spark):
    df = spark.sql("select 'up' name, map('job', 'x', 'zone', '') labels, 1.0D value")
    assert m.select_series(df, "up", job="x", zone="", absent="").count() == 1
    assert m.select_series(df, "up", job="y").count() == 0
    assert promote(df, "job").where(label(promote(df, "job"), "job") == "x").count() == 1
    assert m.select_regex(df, "job", "x|y").count() == 1
    assert m.select_regex(df, "__name__", "u").count() == 0  # the whole name must match
    got = m.attach_labels(df, "web", zone="eu").first().labels
    assert got == {"job": "web", "zone": "eu"}


def test_target_up_has_a_row_for_silent_slots(spark, rows):
    scrapes = samples(spark, [("a", at(0), 1), ("b", at(60), 1)])
    got = m.target_up(scrapes, scrapes, "pod", "1m", at(0), at(60)).select("pod", F.minute("slot").alias("m"), "up")
    assert rows(got) == [("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1)]


def test_relabel_rules(spark):
    df = spark.createDataFrame([("10.0.0.1:80", "true", "9100"), ("10.0.0.2", "trueish", None)], "address string, scrape string, port string")
    assert r.relabel_keep(df, ["scrape"], "true").count() == 1
    out = r.relabel_replace(df, ["address", "port"], r"([^:]+)(?::\d+)?;(\d+)", "$1:$2", "address")
    assert sorted(x.address for x in out.collect()) == ["10.0.0.1:9100", "10.0.0.2"]


def test_keep_list_must_match_the_whole_name(spark):
    df = spark.createDataFrame([("cpu", "t"), ("cpu_total", "t"), ("mem", "off")], "name string, target string")
    settings = spark.createDataFrame([("t", True, "cpu|mem", "30s"), ("off", False, "", "30s")],
                                     "target string, enabled boolean, keep_list string, scrape_interval string")
    assert [x.name for x in r.apply_target_settings(df, settings).collect()] == ["cpu"]


def test_empty_selector_matches_every_target(spark):
    df = spark.createDataFrame([("x", "ns")], "app string, namespace string")
    got = [x.monitor for x in r.match_selector(df, [r.Monitor("all"), r.Monitor("other", {}, ("no",))]).collect()]
    assert got == ["all"]


@pytest.mark.parametrize("slices", [1, 12])
@pytest.mark.parametrize("every, range_", [("15m", "1h"), ("10m", "25m"), ("20s", "20s")])
def test_sliding_ranges_equal_spark_windows(spark, slices, every, range_):
    rng = random.Random(5)
    rows = [(rng.choice("abb"), START + timedelta(seconds=rng.randrange(40_000)), float(rng.randrange(50))) for _ in range(300)]
    df = spark.createDataFrame(sorted({(k, t): v for k, t, v in rows}.items()), "k struct<a: string, ts: timestamp>, value double").select(
        F.col("k.a").alias("k"), F.col("k.ts").alias("ts"), "value")
    got = m.increase_grid(df, ["k"], every, range_, slices)
    width = lambda d: {"m": " minutes", "h": " hours", "s": " seconds"}[d[-1]]
    want = m.with_deltas(df, ["k"]).groupBy(F.window("ts", range_[:-1] + width(range_), every[:-1] + width(every)).start.alias("start"), "k").agg(
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase"))
    assert {(r.start, r.k): round(r.increase, 6) for r in got.collect()} == {(r.start, r.k): round(r.increase, 6) for r in want.collect()}


def test_sliding_ranges_do_not_copy_rows(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value"))
    plans = [m.increase_grid(df, ["k"], "15s", r)._jdf.queryExecution().optimizedPlan().toString() for r in ("1h", "4h")]
    assert all("Expand" not in p for p in plans) and plans[0].count("\n") == plans[1].count("\n")


def test_label_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "samples")
    spark.createDataFrame([("m", "s", None, 1.0), ("m", "t", "v", 2.0)], "name string, service string, version string, value double").write.parquet(path)
    df = m.select_series(spark.read.parquet(path), "m", service="s", version="")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(service,s)" in plan and [r.value for r in df.collect()] == [1.0]
