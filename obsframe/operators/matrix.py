"""Comparison matrices as long rows ``(doc, table_no, row_no, entity, attribute, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks that open a supported and a not supported cell.
SUPPORTED, UNSUPPORTED = "✅", "❌"


def flag_counts(cells: DataFrame) -> DataFrame:
    """Cells marked supported and not supported, per document, table and attribute."""
    by = ["doc", "table_no", "attribute"]
    return cells.groupBy(*by).agg(
        F.count_if(F.col("value").startswith(SUPPORTED)).alias("supported"),
        F.count_if(F.col("value").startswith(UNSUPPORTED)).alias("unsupported"),
        F.count(F.lit(1)).alias("cells"))


def labelled_numbers(cells: DataFrame) -> DataFrame:
    """Numbers that follow a label, as in ``AUC 0.95``, ``loss -0.5``, ``AUC: 1`` or ``accuracy: 79.1%``: one row each.

    Labels may be in any script. A whole number counts after a colon or equals sign, or as a percentage,
    since others are mostly part of a name.
    """
    gap = r"[^\p{L}\p{N}%.|+-]"
    pattern = (rf"(\p{{L}}[\p{{L}}\p{{N}}-]*)(?:{gap}{{1,6}}?([+-]?\d+\.\d+|[+-]?\d+(?=\s*%))|\s*[:=：＝]\s*([+-]?\d+(?![\p{{L}}\p{{N}}.])))(\s*%)?")
    every = F.regexp_extract_all("value", F.lit(pattern), F.lit(0))
    found = cells.withColumn("hit", F.explode(every))
    return found.select(
        *[c for c in cells.columns if c != "value"],
        F.regexp_extract("hit", pattern, 1).alias("label"),
        F.concat(F.regexp_extract("hit", pattern, 2), F.regexp_extract("hit", pattern, 3)).cast("double").alias("number"),
        F.col("hit").endswith("%").alias("is_percent"))


def pivot_cells(cells: DataFrame, rows: list[str], columns: str, values: list[str], value: str = "value") -> DataFrame:
    """Long back to wide; the wanted columns are given, so no extra pass looks for them."""
    return cells.groupBy(*rows).pivot(columns, values).agg(F.first(value, ignorenulls=True))
