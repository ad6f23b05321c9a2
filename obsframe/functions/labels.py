"""Label access on samples and targets; an absent label reads as the empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(df: DataFrame, name: str) -> Column:
    """The promoted column if there is one, else the entry of the ``labels`` map.

    Promoted columns are worth having: filters on them reach the parquet scan, filters
    on map entries do not.
    """
    column = F.col(f"`{name}`") if name in df.columns else F.col("labels")[name]
    return F.coalesce(column, F.lit(""))


def label_is(df: DataFrame, name: str, value: str) -> Column:
    """Whether a label has a value; on a promoted column this reaches the scan unless the value is empty."""
    column = F.col(f"`{name}`") if name in df.columns else F.col("labels")[name]
    return column == value if value else label(df, name) == ""


def promote(df: DataFrame, *names: str) -> DataFrame:
    """Turn map entries into columns."""
    return df.withColumns({n: F.col("labels")[n] for n in names})


def metric_name(template: str) -> Column:
    """Fill ``{column}`` parts of a name template from columns."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += ([F.lit(text)] if text else []) + [F.col(name).cast("string")]
    return F.concat(*pieces, *([F.lit(rest)] if rest else []))
