"""Record shapes."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType,
    TimestampType,
)

CORRUPT = "_corrupt_record"


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


PROMPT = _struct(id=LongType(), prompt=StringType())
MESSAGE = _struct(role=StringType(), content=StringType())
CHAT = _struct(messages=ArrayType(MESSAGE))
METRIC_SAMPLE = _struct(name=StringType(), labels=MapType(StringType(), StringType()), ts=TimestampType(), value=DoubleType())
TARGET_SETTINGS = _struct(target=StringType(), enabled=BooleanType(), keep_list=StringType(), scrape_interval=StringType())
CONTAINER_LOG = _struct(TimeGenerated=TimestampType(), PodNamespace=StringType(), PodName=StringType(),
                        ContainerName=StringType(), LogMessage=StringType())
SPAN = _struct(trace_id=StringType(), span_id=StringType(), parent_id=StringType(), service=StringType(),
               operation=StringType(), start_us=LongType(), duration_us=LongType(),
               tags=MapType(StringType(), StringType()))
HISTORY_ENTRY = _struct(query=StringType(), response=StringType(), timestamp=StringType())
AGENT_STATE = _struct(agent_id=StringType(), created_at=StringType(), resumed_at=StringType(), last_updated=StringType(),
                      reflection_count=IntegerType(), history=ArrayType(HISTORY_ENTRY))
MODEL_OUTPUT = ArrayType(_struct(
    type=StringType(), id=StringType(), response_id=StringType(), phase=StringType(), role=StringType(),
    content=ArrayType(_struct(type=StringType(), text=StringType())), status=StringType()))
OS_INVENTORY = _struct(Timestamp=StringType(), Computer=StringType(), OsName=StringType(), OsVersion=StringType(),
                       Architecture=StringType(), Edition=StringType(), ProductName=StringType(), InstallDate=StringType())
TRAINING_STEP = _struct(epoch=IntegerType(), step=IntegerType(), loss=DoubleType())

# Billing models and the fields of a benchmark record (name, JSON type, required).
BILLING_MODELS = ("compute_core_hours", "node_uptime", "per_token")
BENCHMARK_FIELDS = (
    ("platform", "string", True),
    ("billing_model", "string", False),
    ("workload", "string", True),
    ("model", "string", False),
    ("gpu_type", "string", False),
    ("gpu_count", "integer", False),
    ("requests", "integer", True),
    ("successful_requests", "integer", True),
    ("failed_requests", "integer", True),
    ("duration_seconds", "number", False),
    ("average_latency_ms", "number", False),
    ("p95_latency_ms", "number", False),
    ("tokens_per_second", "number", False),
)
_SPARK_TYPES = {"string": StringType(), "integer": LongType(), "number": DoubleType()}
BENCHMARK_RESULT = StructType([
    StructField(name, _SPARK_TYPES[kind], not required) for name, kind, required in BENCHMARK_FIELDS])


def benchmark_schema() -> dict:
    """The JSON Schema of a benchmark record."""
    properties = {name: {"type": kind if required else [kind, "null"]} for name, kind, required in BENCHMARK_FIELDS}
    properties["billing_model"]["enum"] = [*BILLING_MODELS, None]
    return {"type": "object", "properties": properties, "required": [name for name, _, required in BENCHMARK_FIELDS if required]}
