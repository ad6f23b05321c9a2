"""Readers with declared schemas. Nothing is inferred, and no row is dropped: text that
does not parse stays in ``_corrupt_record``."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType, StructField, StructType

from obsframe import schemas
from obsframe.sources.manifests import names
from obsframe.sources.texts import whole_files


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON Lines with a fixed schema."""
    return _json(spark, path, schema)


def read_chat_jsonl(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Chat records as one row per message with its position from 0.

    ``key`` names a further field that identifies the record.
    """
    fields = [StructField(key, StringType())] if key else []
    chats = _json(spark, path, StructType([*fields, *schemas.CHAT.fields]))
    return explode_messages(chats)


def explode_messages(chats: DataFrame) -> DataFrame:
    others = [c for c in chats.columns if c not in ("messages", schemas.CORRUPT)]
    broken = [schemas.CORRUPT] if schemas.CORRUPT in chats.columns else []
    return chats.select(*others, *broken, F.posexplode_outer("messages").alias("position", "m")).select(
        *others, "position", "m.role", "m.content", *broken)


def read_state(spark: SparkSession, path: str, ids: Iterable[str] | None = None, now: str | None = None) -> DataFrame:
    """One JSON state document per file; the agent is the file's stem.

    With ``ids`` only the files of these agents are opened. An id without a file gets the default record: created ``now``, no
    turns, no history. ``restored`` tells the two apart.
    """
    if ids is None:
        return parse_state(whole_files(spark, path))
    wanted = sorted(set(ids))
    there = {n.removesuffix(".json") for n in names(spark, path) if n.endswith(".json")}
    paths = [f"{path}/{i}.json" for i in wanted if i in there]
    moment = now or datetime.now(timezone.utc).isoformat()
    history = T.ArrayType(schemas.HISTORY_ENTRY)
    fresh = spark.createDataFrame([(i,) for i in wanted if i not in there], "agent_id string").select(
        "agent_id", F.lit(moment).alias("created_at"), F.lit(None).cast("string").alias("last_updated"), F.lit(0).alias("reflection_count"),
        F.array().cast(history).alias("history"), F.lit(None).cast("string").alias(schemas.CORRUPT), F.lit(False).alias("restored"))
    if not paths:
        return fresh
    return parse_state(whole_files(spark, paths)).withColumn("restored", F.lit(True)).unionByName(fresh)


def parse_state(files: DataFrame) -> DataFrame:
    """State documents held as rows of ``path`` and whole ``value``."""
    docs = _documents(files, schemas.AGENT_STATE)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    return docs.select(stem.alias("agent_id"), "d.created_at", "d.last_updated", "d.reflection_count", "d.history",
                       schemas.CORRUPT)


def read_logs(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The container log table."""
    reader = spark.read.schema(schemas.CONTAINER_LOG)
    return reader.parquet(path) if kind == "parquet" else _json(spark, path, schemas.CONTAINER_LOG)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans as JSON Lines in the Zipkin v2 form."""
    return parse_spans(spark.read.text(path))


def parse_spans(lines: DataFrame, value: str = "value") -> DataFrame:
    """Zipkin v2 span JSON to flat spans; times are microseconds."""
    shape = "traceId string, id string, parentId string, name string, timestamp bigint, duration bigint, " \
            "localEndpoint struct<serviceName: string>, tags map<string, string>"
    span = lines.select(F.col(value).alias("raw"), F.from_json(value, shape).alias("s"))
    return span.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.id").alias("span_id"), F.col("s.parentId").alias("parent_id"),
        F.col("s.localEndpoint.serviceName").alias("service"), F.col("s.name").alias("operation"),
        F.col("s.timestamp").alias("start_us"), F.timestamp_micros("s.timestamp").alias("start"),
        F.col("s.duration").alias("duration_us"), F.col("s.tags").alias("tags"),
        F.when(F.col("s.traceId").isNull(), F.col("raw")).alias(schemas.CORRUPT))


def read_os_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Operating system records, one JSON document per file."""
    return parse_os_inventory(whole_files(spark, path))


def parse_os_inventory(files: DataFrame) -> DataFrame:
    """The record, not the file name, tells the computer: all nodes use one file name."""
    return _documents(files, schemas.OS_INVENTORY).select("d.*", schemas.CORRUPT)


def stream_table(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet",
                 files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A folder to which files are added, as a stream."""
    reader = spark.readStream.schema(schema).format(kind).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def _documents(files: DataFrame, schema: StructType) -> DataFrame:
    text = F.regexp_replace("value", "^\ufeff", "")  # some writers put a byte order mark first
    docs = files.select("path", "value", F.from_json(text, schema).alias("d"))
    named = [F.col(f"d.{f.name}").isNull() for f in schema.fields]
    broken = reduce(lambda a, b: a & b, named)
    return docs.withColumn(schemas.CORRUPT, F.when(broken, F.col("value")))


def _with_corrupt(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(schemas.CORRUPT, StringType())])


def _json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return (spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", schemas.CORRUPT).json(path))
