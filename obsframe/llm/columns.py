"""Small helpers on column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spare(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet, so helper columns never clash with extra ones."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``, safe for names with dots."""
    return [F.col(f"`{c}`") for c in df.columns]
