"""Labelled rows that a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids whose CRC-32 leaves the remainder 2; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def sample(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """About ``per_class`` rows (doc_id, label) of each class outside the held-out fold, and each class's true count.

    Rows are chosen by a hash of the id, so the choice is the same on every run and at every
    partitioning. The result has about ``2 * per_class`` rows however many labels there are.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("_max")).where("label = _max").drop("_max")
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for value, count in counts.items():
        wanted = wanted | ((F.col("label") == value) & (place < per_class / count))
    return usable.where(wanted), {k: float(v) for k, v in counts.items()}
