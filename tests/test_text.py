import pytest
from pyspark.sql import functions as F

from obsframe.functions import text as t
from obsframe.functions.labels import metric_name
from obsframe.functions.units import duration_seconds, parse_duration, quantity_value
from obsframe.operators import logs


@pytest.mark.parametrize("line, term, hit", [
    ("GET HTTP/1.1 ok", "http/1.1", True),
    ("GET HTTP/1.10 ok", "HTTP/1.1", False),
    ("xvia_upstream", "via_upstream", False),
    ("via_upstream", "VIA_UPSTREAM", True),
    ("outbound|9080||a", "outbound|", True),
    ("inoutbound|9080", "outbound|", False),
    ("a.b.svc", "b.svc", True),
    ("bb.svc", "b.svc", False),
    ("x (a+b) y", "(a+b)", True),
    ("über", "ber", True),  # only letters and digits of ASCII are term characters
    (r"a \E b", r"\E", True),
])
def test_has(spark, line, term, hit):
    assert spark.createDataFrame([(line,)], "x string").select(t.has("x", term)).first()[0] is hit


def test_has_is_null_for_null(spark):
    assert spark.sql("select cast(null as string) x").where(t.has("x", "a")).count() == 0


@pytest.mark.parametrize("written, seconds", [
    ("PT15M", 900), ("PT24H", 86400), ("P1DT2H", 93600), ("PT1.5S", 1.5), ("PT1H30M5S", 5405),
    ("15s", 15), ("1m", 60), ("1h30m", 5400), ("100ms", 0.1), ("2d", 172800),
    ("P", None), ("PT", None), ("15", None), ("m", None), ("", None)])
def test_durations(spark, written, seconds):
    got = spark.createDataFrame([(written,)], "x string").select(duration_seconds("x")).first()[0]
    assert got == (pytest.approx(seconds) if seconds is not None else None)
    if seconds is None:
        with pytest.raises(ValueError):
            parse_duration(written)
    else:
        assert parse_duration(written).total_seconds() == pytest.approx(seconds)


@pytest.mark.parametrize("written, value", [
    ("240Gi", 240 * 2**30), ("500m", 0.5), ("2000m", 2.0), ("512Mi", 512 * 2**20), ("1.5", 1.5), ("3k", 3000),
    ("1Zi", None), ("Gi", None), ("", None)])
def test_quantities(spark, written, value):
    got = spark.createDataFrame([(written,)], "x string").select(quantity_value("x")).first()[0]
    assert got == (pytest.approx(value) if value is not None else None)


def test_strip_removes_unicode_space(spark):
    got = spark.createDataFrame([(" \t a b 　\n",)], "x string").select(t.strip("x")).first()[0]
    assert got == "a b"


def test_small_helpers(spark):
    df = spark.createDataFrame([("http://h//", '{"a":{"b":2}}', [1, 2, 3])], "u string, j string, ids array<int>")
    got = df.select(t.url_join("u", "/v1"), t.json_field("j", "a.b"), t.pad_to("ids", 5, 0), t.mask_for("ids", 5),
                    t.pad_to("ids", 2, 0), t.mask_for("ids", 2), t.fill_template(F.lit("__A__!"), {"__A__": "x"}),
                    t.get_or(F.lit(None).cast("string"), "d"), t.preview(F.lit("abcdef"), 3),
                    t.iso_utc(F.lit("2026-07-20 00:00:00").cast("timestamp"))).first()
    assert tuple(got) == ("http://h/v1", "2", [1, 2, 3, 0, 0], [1, 1, 1, 0, 0], [1, 2], [1, 1], "x!", "d", "abc",
                          "2026-07-20T00:00:00+00:00")


def test_metric_name_keeps_the_text_between_parts(spark):
    df = spark.createDataFrame([("app", "cpu")], "name string, metric string")
    assert df.select(metric_name("x_{name}-{metric}_end")).first()[0] == "x_app-cpu_end"


def test_nested_project_reads_missing_fields_as_null(spark):
    df = spark.sql("select named_struct('l', map('pool', 'a')) m, '{\"x\":{\"y\":3}}' j")
    got = logs.nested_project(df, F.col("m.l")["pool"] == "a", pool="m.l.pool", none="m.l.other", y="j:x.y", z="j:x.z").first()
    assert tuple(got) == ("a", None, "3", None)


def test_tail_limit_is_pushed_below_the_shuffle(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 k", "id ts").write.parquet(str(tmp_path / "t"))
    out = logs.tail_per_key(spark.read.parquet(str(tmp_path / "t")), ["k"], ["ts"], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted((r.k, r.ts) for r in out.collect()) == [(0, 6), (0, 8), (1, 7), (1, 9)]


def test_equality_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.sql("select 'p' ContainerName, 'x HTTP/1.1' LogMessage, timestamp_ntz'2024-01-01' TimeGenerated, "
              "'n' PodNamespace, 'q' PodName, 1 unused").write.parquet(path)
    plan = logs.access_lines(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ContainerName,istio-proxy)" in plan
    assert "unused" not in plan
