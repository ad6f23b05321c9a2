"""Trace queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.catalog.registry import query
from obsframe.operators import traces
from obsframe.views import Lake


@query("trace_sample", """
    SELECT trace_id, span_id FROM spans
    WHERE CAST('0x' || substr(md5(CAST(trace_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 1000
""", "spans")
def _(lake: Lake) -> DataFrame:
    return traces.sample_traces(lake.spans, 10.0).select("trace_id", "span_id")


@query("service_edges", """
    SELECT p.service AS caller, c.service AS callee, count(*) AS calls, round(avg(c.duration_us), 6) AS mean_us
    FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id GROUP BY ALL
""", "spans")
def _(lake: Lake) -> DataFrame:
    return traces.service_edges(lake.spans).withColumn("mean_us", F.round("mean_us", 6))


@query("span_self_time", """
    SELECT s.trace_id, s.span_id, s.duration_us, greatest(s.duration_us - CAST(coalesce(c.child_us, 0) AS BIGINT), 0) AS self_us
    FROM spans s LEFT JOIN (SELECT trace_id, parent_id, sum(duration_us) AS child_us FROM spans GROUP BY ALL) c
        ON s.trace_id = c.trace_id AND s.span_id = c.parent_id
""", "spans")
def _(lake: Lake) -> DataFrame:
    return traces.span_self_time(lake.spans).select("trace_id", "span_id", "duration_us", "self_us")


@query("span_performance", """
    SELECT service, operation, count(*) AS calls, round(avg(duration_us), 6) AS mean_us,
           round(quantile_cont(duration_us, 0.95), 6) AS p95_us FROM spans GROUP BY ALL
""", "spans")
def _(lake: Lake) -> DataFrame:
    return traces.span_performance(lake.spans).withColumns({
        "mean_us": F.round("mean_us", 6), "p95_us": F.round("p95_us", 6)})


@query("trace_timeline", """
    WITH RECURSIVE walk AS (
        SELECT trace_id, span_id, 0 AS depth FROM spans WHERE parent_id IS NULL
        UNION ALL
        SELECT s.trace_id, s.span_id, w.depth + 1 FROM spans s JOIN walk w ON s.trace_id = w.trace_id AND s.parent_id = w.span_id)
    SELECT s.trace_id, s.span_id, s.start_us - min(s.start_us) OVER (PARTITION BY s.trace_id) AS offset_us, w.depth
    FROM spans s JOIN walk w ON s.trace_id = w.trace_id AND s.span_id = w.span_id
""", "spans")
def _(lake: Lake) -> DataFrame:
    return traces.trace_timeline(lake.spans).select("trace_id", "span_id", "offset_us", "depth")
