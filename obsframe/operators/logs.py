"""Container log questions. Filters come first, so they run inside the scan stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.functions.text import has

# Container names and terms of mesh access logs.
SIDECAR = "istio-proxy"
INGRESS = "istio-ingressgateway"
REQUEST_TERM = "HTTP/1.1"
UPSTREAM_TERM = "via_upstream"


def from_container(logs: DataFrame, name: str = SIDECAR) -> DataFrame:
    return logs.where(F.col("ContainerName") == name)


def from_containers(logs: DataFrame, names: list[str]) -> DataFrame:
    return logs.where(F.col("ContainerName").isin(*names))


def with_term(logs: DataFrame, term: str) -> DataFrame:
    return logs.where(has("LogMessage", term))


def newest_first(df: DataFrame, column: str = "TimeGenerated") -> DataFrame:
    return df.orderBy(F.desc(column))


def access_lines(logs: DataFrame) -> DataFrame:
    """Sidecar lines of requests that reached an upstream."""
    lines = with_term(with_term(from_container(logs), REQUEST_TERM), UPSTREAM_TERM)
    return newest_first(lines.select("TimeGenerated", "PodNamespace", "PodName", "LogMessage"))


def direction_lines(logs: DataFrame, direction: str = "outbound") -> DataFrame:
    """Sidecar lines of inbound or of outbound traffic."""
    lines = with_term(from_container(logs), f"{direction}|")
    return newest_first(lines.select("TimeGenerated", "PodName", "LogMessage"))


def direction(message: Column | str) -> Column:
    """``outbound``, ``inbound`` or null."""
    return F.when(has(message, "outbound|"), "outbound").when(has(message, "inbound|"), "inbound")


def service_lines(logs: DataFrame, service: str) -> DataFrame:
    """Sidecar lines that mention a service by its full name."""
    lines = with_term(from_container(logs), service)
    return newest_first(lines.select("TimeGenerated", "PodName", "LogMessage"))


def troubleshoot(logs: DataFrame) -> DataFrame:
    """Request lines of sidecars and ingress gateways together."""
    lines = with_term(from_containers(logs, [SIDECAR, INGRESS]), REQUEST_TERM)
    return newest_first(lines.select("TimeGenerated", "PodNamespace", "PodName", "ContainerName", "LogMessage"))


def tail_per_key(df: DataFrame, keys: list[str], order: list[str], n: int = 50) -> DataFrame:
    """Last ``n`` rows of each key, numbered from the newest.

    Spark pushes the limit below the shuffle, so a hot key sends at most ``n`` rows per task.
    """
    back = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("from_end", F.row_number().over(back)).where(F.col("from_end") <= n)


def oldest_first(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.asc(column))


def nested_project(df: DataFrame, where: Column | None = None, **paths: str) -> DataFrame:
    """Rows that pass ``where``, with nested paths as new columns; a missing field reads null.

    A path is ``struct.field``, ``map.key`` or, below a JSON text column, ``column:a.b``.
    """
    rows = df if where is None else df.where(where)
    return rows.select(*[_path(p).alias(n) for n, p in paths.items()])


def _path(path: str) -> Column:
    column, colon, rest = path.partition(":")
    if colon:
        return F.get_json_object(F.col(column), f"$.{rest}")
    parts = path.split(".")
    out = F.col(parts[0])
    for part in parts[1:]:
        out = out[part]
    return out


def array_count_where(array: Column | str, field: str, value: str) -> Column:
    """How many structs of an array have ``field`` equal to ``value``."""
    items = F.col(array) if isinstance(array, str) else array
    return F.size(F.filter(items, lambda item: item[field] == value))
