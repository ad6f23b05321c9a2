"""Streaming queries: the table file is the stream's source, closed rows go to parquet
files in the shared folder, and those files are the result."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.catalog.registry import query
from obsframe.session import work_dir
from obsframe.sources.files import stream_table
from obsframe.sources.sinks import read_latest
from obsframe.streaming import streams as s
from obsframe.views import Lake

CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _events(lake: Lake) -> DataFrame:
    rows = stream_table(lake.spark, lake.folder, lake.events.schema, pathGlobFilter="events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _result(lake: Lake, rows: DataFrame, name: str) -> DataFrame:
    base = work_dir(lake.spark, name)
    s.stream_to_files(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = lake.spark.read.schema(rows.schema).parquet(f"{base}/out")
    moments = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp"]
    return out.withColumns({m: F.col(m).cast("timestamp_ntz") for m in moments})


@query("src_stream_files", "SELECT event_id, ts, event_type, value FROM events")
def _(lake: Lake) -> DataFrame:
    return _result(lake, _events(lake).select("event_id", "ts", "event_type", "value"), "stream-files")


@query("stream_rollup", f"""
    SELECT start, event_type, round(avg(value), 6) AS average, min(value) AS minimum, max(value) AS maximum,
           round(sum(value), 6) AS total, count(*) AS count
    FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS start FROM events)
    WHERE start + INTERVAL 15 MINUTE <= {CLOSED} GROUP BY start, event_type
""")
def _(lake: Lake) -> DataFrame:
    out = _result(lake, s.stream_rollup(_events(lake), ["event_type"], "PT15M", "10m"), "rollup")
    return out.withColumns({"average": F.round("average", 6), "total": F.round("total", 6)})


@query("stream_alert", f"""
    WITH rates AS (SELECT date_trunc('hour', ts) AS start, count(*) AS requests, count(*) FILTER (status >= 400) AS errors
                   FROM requests GROUP BY ALL)
    SELECT start, requests, errors, round(errors / requests, 9) AS error_rate FROM rates
    WHERE errors / requests > 0.3 AND start + INTERVAL 1 HOUR <= {CLOSED}
""", "requests")
def _(lake: Lake) -> DataFrame:
    event = F.col("event_id")
    status = (F.when(F.col("event_type") == "error", F.when(event % 2 == 0, 500).otherwise(429))
              .when(event % 17 == 0, 404).otherwise(200))
    rows = s.stream_alert(_events(lake).withColumn("status", status), "1h", 0.3, "10m")
    return _result(lake, rows, "alert").withColumn("error_rate", F.round("error_rate", 9))


@query("stream_idle", f"""
    WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens
                    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM marked)
    SELECT user_id, min(ts) AS start, max(ts) AS "end", max(ts) + INTERVAL 30 MINUTE AS evicted_at, count(*) AS events
    FROM numbered GROUP BY user_id, no HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}
""")
def _(lake: Lake) -> DataFrame:
    return _result(lake, s.stream_idle(_events(lake), "user_id", "30m", "10m"), "idle")


@query("stream_increase", f"""
    WITH deltas AS (SELECT ts, event_type, CASE WHEN value >= prev THEN value - prev WHEN prev IS NOT NULL THEN value END AS delta
        FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts) AS prev FROM events)),
    steps AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start FROM deltas, range(4) AS r(k)
              WHERE ts <= {CLOSED})
    SELECT start, event_type, round(coalesce(sum(delta), 0), 6) AS increase FROM steps
    WHERE start + INTERVAL 1 HOUR <= {CLOSED} GROUP BY start, event_type
""")
def _(lake: Lake) -> DataFrame:
    samples = _events(lake).withColumn("pod", F.col("user_id") % 4)
    rows = s.stream_increase(samples, ["event_type", "pod"], ["event_type"], "1h", "15m", "10m")
    return _result(lake, rows, "increase").withColumn("increase", F.round("increase", 6))


@query("stream_agent_state", """
    SELECT CAST(user_id AS VARCHAR) AS agent_id, event_id AS position, event_type AS query, props AS response,
           row_number() OVER w AS reflection_count, CAST(least(row_number() OVER w - 1, 5) AS INTEGER) AS recent_turns,
           min(ts) OVER (PARTITION BY user_id) AS created_at
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def _(lake: Lake) -> DataFrame:
    turns = _events(lake).select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("position"), "ts",
                                 F.col("event_type").alias("query"), F.col("props").alias("response"))
    return _result(lake, s.stream_agent_state(turns), "agent").drop("ts")


@query("stream_agent_lives", f"""
    WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens
                    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    lives AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS life FROM marked),
    turns AS (SELECT *, row_number() OVER w AS n, min(ts) OVER w AS born FROM lives WINDOW w AS (PARTITION BY user_id, life ORDER BY ts))
    SELECT CAST(user_id AS VARCHAR) AS agent_id, event_id AS position, ts, event_type AS query, props AS response, n AS reflection_count,
           CAST(least(n - 1, 5) AS INTEGER) AS recent_turns, born AS created_at, false AS evicted FROM turns WHERE ts <= {CLOSED}
    UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, max(ts) + INTERVAL 30 MINUTE, NULL, NULL, count(*), CAST(least(count(*), 5) AS INTEGER),
           min(ts), true FROM turns GROUP BY user_id, life HAVING max(ts) + INTERVAL 30 MINUTE < {CLOSED}
""")
def _(lake: Lake) -> DataFrame:
    turns = _events(lake).select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("position"), "ts",
                                 F.col("event_type").alias("query"), F.col("props").alias("response"))
    return _result(lake, s.stream_agent_lives(turns, "10m", idle="30m"), "lives")


@query("stream_replies", f"""
    SELECT event_id AS response_id, props AS reasoning, event_type || '/' || user_id AS answer, CAST(4 AS BIGINT) AS chunks,
           ts + INTERVAL 360 SECOND AS ended_at, true AS complete FROM events WHERE ts + INTERVAL 360 SECOND <= {CLOSED} + INTERVAL 360 SECOND
""")
def _(lake: Lake) -> DataFrame:
    # Four chunks two minutes apart, which is longer than a request may be silent elsewhere; the second is sent twice.
    piece = lambda seq, reasoning, content, at: F.struct(
        F.lit(seq).alias("seq"), reasoning.cast("string").alias("reasoning"), content.cast("string").alias("content"), F.lit(at).alias("at"))
    none = F.lit(None)
    pieces = F.array(piece(3, none, F.col("user_id"), 3), piece(1, none, F.col("event_type"), 1), piece(0, F.col("props"), none, 0),
                     piece(2, none, F.lit("/"), 2), piece(1, none, F.lit("late"), 2))
    deltas = _events(lake).select(F.col("event_id").alias("response_id"), "ts", F.explode(pieces).alias("p")).select(
        "response_id", (F.col("ts") + F.expr("make_dt_interval(0, 0, 2 * p.at, 0)")).alias("ts"), "p.*", (F.col("p.seq") == 3).alias("is_last"))
    return _result(lake, s.stream_replies(deltas, "10m"), "replies")


@query("stream_delta_assembly", f"""
    SELECT event_id AS response_id, CAST(0 AS BIGINT) AS segment_no, props AS reasoning,
           event_type || '/' || user_id AS answer, true AS complete FROM events WHERE ts + INTERVAL 90 SECOND <= {CLOSED}
""")
def _(lake: Lake) -> DataFrame:
    # Each event stands for a reply of four chunks, the first of which is reasoning.
    piece = lambda seq, reasoning, content: F.struct(
        F.lit(seq).alias("seq"), reasoning.cast("string").alias("reasoning"), content.cast("string").alias("content"))
    none = F.lit(None)
    pieces = F.array(piece(3, none, F.col("user_id")), piece(1, none, F.col("event_type")),
                     piece(0, F.col("props"), none), piece(2, none, F.lit("/")))
    deltas = _events(lake).select(F.col("event_id").alias("response_id"), "ts", F.explode(pieces).alias("p")).select(
        "response_id", "ts", "p.*", (F.col("p.seq") == 3).alias("is_last"))
    return _result(lake, s.stream_delta_assembly(deltas, "10m"), "assembly")


@query("stream_upsert", """
    SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id
""")
def _(lake: Lake) -> DataFrame:
    base = work_dir(lake.spark, "upsert")
    states = _events(lake).select("user_id", "ts", "event_id", "event_type")
    s.stream_upsert(states, "user_id", ["ts"], f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return read_latest(lake.spark, f"{base}/state", "user_id", ["ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
