"""Streaming twins of the batch operators.

Each takes a streaming DataFrame with a ``TIMESTAMP`` event time and an explicit
watermark. Rows later than the watermark are dropped by Spark and counted in the
query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import NumericType

from obsframe.functions.units import interval, parse_duration
from obsframe.sources.manifests import get_text, put_text
from obsframe.sources.sinks import compact, upsert_latest
from obsframe.streaming.processors import DONE, AgentTurns, CounterDeltas, OrderedTurns, PassedReplies, ReplyBuckets, SlidingSums

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_rollup(samples: DataFrame, by: list[str], every: str, watermark: str) -> DataFrame:
    """Average, minimum, maximum, total and count per tumbling window, once it is closed."""
    return (samples.withWatermark("ts", interval(watermark))
            .groupBy(F.window("ts", interval(every)).alias("w"), *by)
            .agg(F.avg("value").alias("average"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
                 F.sum("value").alias("total"), F.count("value").alias("count"))
            .select(F.col("w.start").alias("start"), *by, "average", "minimum", "maximum", "total", "count"))


def stream_alert(requests: DataFrame, every: str, threshold: float, watermark: str) -> DataFrame:
    """Closed windows whose share of 4xx and 5xx answers passes the threshold."""
    bad = F.count_if(F.col("status").between(400, 599))
    rates = (requests.withWatermark("ts", interval(watermark))
             .groupBy(F.window("ts", interval(every)).alias("w"))
             .agg(F.count(F.lit(1)).alias("requests"), bad.alias("errors")))
    return rates.select(F.col("w.start").alias("start"), "requests", "errors",
                        (F.col("errors") / F.col("requests")).alias("error_rate")).where(F.col("error_rate") > threshold)


def stream_idle(rows: DataFrame, key: str, gap: str, watermark: str) -> DataFrame:
    """A session's row when it has been idle for ``gap``: the moment to evict it."""
    return (rows.withWatermark("ts", interval(watermark))
            .groupBy(key, F.session_window("ts", interval(gap)).alias("w"))
            .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"))
            .select(key, "start", "end", F.col("w.end").alias("evicted_at"), "events"))


def stream_deltas(samples: DataFrame, series: list[str], watermark: str) -> DataFrame:
    """Reset-aware step of each sample from the one before it in its series.

    The state is one sample per series, plus the samples the watermark has not passed.
    """
    _use_rocksdb(samples.sparkSession)
    keyed = samples.select(*series, "ts", F.unix_micros("ts").alias("us"), "value").withWatermark("ts", interval(watermark))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*series).schema]
                       + ["ts timestamp", "value double", "delta double"])
    return keyed.groupBy(*series).transformWithStateInPandas(
        CounterDeltas(tuple(series)), outputStructType=schema, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="ts")


def stream_increase(samples: DataFrame, series: list[str], by: list[str], range_: str, step: str,
                    watermark: str) -> DataFrame:
    """Growth of counters over a sliding range, once per ``step``, summed by labels.

    Deltas are summed once per step and label; a range adds up the panes inside it. So rows are not copied into every
    range they lie in. A range that is no multiple of the step is left to Spark's own sliding windows.
    """
    deltas = stream_deltas(samples, series, watermark)
    width, every = (round(parse_duration(d).total_seconds() * 1_000_000) for d in (range_, step))
    if width % every or width == every:
        return (deltas.groupBy(F.window("ts", interval(range_), interval(step)).alias("w"), *by)
                .agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase"))
                .select(F.col("w.start").alias("start"), *by, "increase"))
    panes = deltas.groupBy(F.window("ts", interval(step)).alias("w"), *by).agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("value"))
    keyed = panes.select(*by, F.window_time("w").alias("ts"), F.unix_micros("w.start").alias("pane"), "value")
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*by).schema)
    return keyed.groupBy(*by).transformWithStateInPandas(
        SlidingSums(tuple(by), width, every), outputStructType=f"start timestamp{kinds}, increase double", outputMode="Append",
        timeMode="EventTime")


def stream_agent_state(turns: DataFrame, recent: int = 5) -> DataFrame:
    """Per turn the agent's reply record, with count and last turns kept as state.

    ``turns`` has ``agent_id, position, ts, query, response``.
    """
    _use_rocksdb(turns.sparkSession)
    schema = "agent_id string, position long, ts timestamp, query string, response string, reflection_count long, " \
             "recent_turns int, created_at timestamp"
    rows = turns.select(F.col("agent_id").cast("string").alias("agent_id"), F.col("position").cast("long").alias("position"),
                        F.unix_micros("ts").alias("us"), "query", "response")
    return rows.groupBy("agent_id").transformWithStateInPandas(
        AgentTurns(recent), outputStructType=schema, outputMode="Append", timeMode="None")


def stream_agent_lives(turns: DataFrame, watermark: str, recent: int = 5, idle: str | None = None,
                       saved: DataFrame | None = None) -> DataFrame:
    """``stream_agent_state`` in order of event time: the same rows however the turns are dealt over files and batches.

    After a pause longer than ``idle`` the agent's state leaves with a last row, which has no turn: ``evicted``, its ``ts`` the moment
    of leaving, its ``reflection_count`` the turns of that life. Without ``idle`` agents stay. ``saved`` is the result of ``fold_state``; agents in it go on counting.
    """
    _use_rocksdb(turns.sparkSession)
    rows = turns.select(F.col("agent_id").cast("string").alias("agent_id"), F.col("position").cast("long").alias("position"),
                        "ts", F.unix_micros("ts").alias("us"), "query", "response").withWatermark("ts", interval(watermark))
    schema = "agent_id string, position long, ts timestamp, query string, response string, reflection_count long, " \
             "recent_turns int, created_at timestamp, evicted boolean"
    limit = None if idle is None else round(parse_duration(idle).total_seconds() * 1_000_000)
    start = None if saved is None else _last_turns(saved, recent).groupBy("agent_id")
    return rows.groupBy("agent_id").transformWithStateInPandas(
        OrderedTurns(recent, limit), outputStructType=schema, outputMode="Append", timeMode="EventTime", initialState=start)


def _last_turns(saved: DataFrame, recent: int) -> DataFrame:
    """Per agent of the state documents: count, first and last moment, the last turns."""
    turns = F.transform("history", lambda t: F.struct(t["query"].alias("query"), t["response"].alias("response")))
    tail = F.slice(turns, -F.least(F.size(turns), F.lit(recent)), F.lit(recent))
    docs = saved.where(F.size("history") > 0).select(
        F.col("agent_id").cast("string").alias("agent_id"), "reflection_count", "chunk_no",
        *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("created_at", "last_updated")), tail.alias("tail"))
    found = docs.groupBy("agent_id").agg(
        F.max("reflection_count").alias("n"), F.min("created_at").alias("created_us"), F.max("last_updated").alias("last_us"),
        F.flatten(F.sort_array(F.collect_list(F.struct("chunk_no", "tail")))["tail"]).alias("turns"))
    return found.withColumn("turns", F.slice("turns", -F.least(F.size("turns"), F.lit(recent)), F.lit(recent)))


def stream_replies(deltas: DataFrame, watermark: str, silence: str = "10m", buckets: int = 2048) -> DataFrame:
    """One row per reply, once its last chunk and all before it are there and the watermark has passed them.

    A reply may pause for as long as ``silence``; one that stays silent longer goes out as it is, not ``complete``. Of a chunk that came
    twice with different text the one with the earlier ``ts`` counts, at one moment the smaller text. A reply's state is gone once it is out.

    Replies that fill up without a pause wait together in ``buckets``, whose number belongs to the checkpoint; all others get a state of their own.
    """
    _use_rocksdb(deltas.sparkSession)
    field, pause = deltas.schema["response_id"], round(parse_duration(silence).total_seconds() * 1_000_000)
    kind = field.dataType.simpleString()
    text = "string" if isinstance(field.dataType, NumericType) else kind  # pandas would turn whole numbers beside a null into floats
    rows = deltas.select(F.when(F.isnotnull("response_id"), F.pmod(F.xxhash64("response_id"), F.lit(buckets)).cast("int")).otherwise(-1).alias("bucket"),
                         F.col("response_id").cast(text).alias("reply"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("us"),
                         "reasoning", "content", F.coalesce("is_last", F.lit(False)).alias("is_last")).withWatermark("ts", interval(watermark))
    lists = lambda ids, sep: f"ids{sep} array<{ids}>, reasonings{sep} array<string>, answers{sep} array<string>, counts{sep} array<bigint>, " \
                             f"ended_us{sep} array<bigint>"  # noqa: E731
    passed = rows.groupBy("bucket").transformWithStateInPandas(
        ReplyBuckets(pause), outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts",
        outputStructType=f"reply {text}, bucket int, ts timestamp, seq bigint, us bigint, reasoning string, content string, is_last boolean, "
                         f"done struct<{lists(text, ':')}>")
    known = passed.withColumns({"response_id": F.col("reply").cast(kind), "done": F.col("done").cast(f"struct<{lists(kind, ':')}>")}).drop("reply")
    done = known.groupBy("response_id", "bucket").transformWithState(
        PassedReplies(pause), outputMode="Append", timeMode="EventTime", outputStructType=f"{lists(kind, '')}, complete boolean")
    return done.select("complete", F.inline(F.arrays_zip(*DONE))).select(
        F.col("ids").alias("response_id"), F.col("reasonings").alias("reasoning"), F.col("answers").alias("answer"), F.col("counts").alias("chunks"),
        F.timestamp_micros("ended_us").alias("ended_at"), "complete")


def stream_delta_assembly(deltas: DataFrame, watermark: str, timeout: str = "90s", segment: int = 10_000) -> DataFrame:
    """Reasoning and answer text of each reply segment, once no further chunk can come.

    ``deltas`` has ``response_id, seq, ts, reasoning, content, is_last``. A reply silent
    for the request ``timeout`` is over. ``complete`` tells whether its last chunk and
    all before it were seen; a chunk that came twice counts once.
    """
    piece = F.struct("seq", F.coalesce("reasoning", F.lit("")).alias("r"), F.coalesce("content", F.lit("")).alias("c"))
    rows = (deltas.withWatermark("ts", interval(watermark))
            .groupBy("response_id", F.floor(F.col("seq") / segment).alias("segment_no"),
                     F.session_window("ts", interval(timeout)))
            .agg(F.collect_set(piece).alias("s"), F.max("is_last").alias("ended"), F.max("seq").alias("top")))
    pieces = rows.withColumn("p", F.sort_array("s"))
    whole = F.size("p") == F.col("top") - F.col("segment_no") * segment + 1
    return pieces.select(
        "response_id", "segment_no", F.array_join(F.col("p")["r"], "").alias("reasoning"),
        F.array_join(F.col("p")["c"], "").alias("answer"),
        (whole & (F.col("ended") | (F.size("p") == segment))).alias("complete"))


def stream_upsert(states: DataFrame, key: str, order: list[str], path: str, checkpoint: str, compact_every: int | None = None,
                  **trigger) -> StreamingQuery:
    """Write the latest state of each key on every change, and fold the batches into a snapshot every so many of them.

    The run is the query's id, which belongs to the checkpoint: a restart repeats its own batches, a
    new checkpoint starts beside them.
    """
    def write(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        upsert_latest(batch, key, order, path, number, run)
        if compact_every and (number + 1) % compact_every == 0:
            compact(batch.sparkSession, path, key, order)

    return (states.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_to_files(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append closed rows to parquet files, exactly once."""
    return (rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(path))


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks have dropped, of all batches of all queries of a session.

    ``spark.streams.addListener(LateRows(spark, folder))``. The totals of each query are kept under its id, which belongs to the
    checkpoint, in a small file below ``folder``: a restarted query, also of a new session, goes on from there, and a batch that is run again counts once.
    What is counted are rows as they reach the state, where those of one batch, window and key may already be one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.totals = spark, folder.rstrip("/"), {}

    def onQueryStarted(self, event) -> None:
        self._known(str(event.id))

    def onQueryProgress(self, event) -> None:
        step, name = event.progress, str(event.progress.id)
        last, total = self._known(name)
        dropped = sum(state.numRowsDroppedByWatermark for state in step.stateOperators)
        if step.batchId > last:
            self.totals[name] = (step.batchId, total + dropped)
            if dropped:
                put_text(self.spark, f"{self.folder}/{name}.json", json.dumps(self.totals[name]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _known(self, name: str) -> tuple[int, int]:
        if name not in self.totals:
            text = get_text(self.spark, f"{self.folder}/{name}.json")
            self.totals[name] = tuple(json.loads(text)) if text else (-1, 0)
        return self.totals[name]

    def total(self, query: StreamingQuery) -> int:
        """Rows of this query that were dropped, over all its runs, up to the last batch that was reported."""
        return self._known(str(query.id))[1]


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark has dropped, over the progress the query still remembers; ``LateRows`` remembers all."""
    return sum(state["numRowsDroppedByWatermark"] for step in query.recentProgress for state in step["stateOperators"])


def _use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
