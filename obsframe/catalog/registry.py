"""Registered queries, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsframe.views import Lake, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register a function of a ``Lake`` under ``name``."""
    needed = (views,) if isinstance(views, str) else views

    def register(function: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Lake(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, needed)
        return function

    return register
