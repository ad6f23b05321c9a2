"""Exact duplicates of normalised texts, with frequent ones settled without a shuffle.

Texts are equal when they are identical after every run of white space has become one
space; a null text counts as empty. Of equal texts the row with the smallest ``doc_id``
stays (a null id comes last). Rows that share text and id are ties: exactly one of them
stays. An empty table gives an empty result. Extra columns are carried by
``drop_duplicates`` and ignored by ``duplicate_groups``.

Method: a Misra-Gries sketch of the digests, built for each partition and merged in two
levels, names the candidates for frequent digests. Their true counts and winners are then
taken from the data, and this small table (``TRACKED`` rows at most) is broadcast: copies
of frequent texts are removed, or assigned, where they are read. All other digests are rarer
than the sketch's error bound and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.llm.columns import own, spare
from obsframe.session import write_once

TRACKED = 4096       # counters of a sketch: every digest above about rows / 3000 is among them
CANDIDATES = 1024    # digests that are verified and broadcast, 100 bytes each
FAN_IN = 64          # partitions whose sketches meet in one task of the first level


def normal_text(text: Column) -> Column:
    """Every run of white space as one space; runs that are one plain space already are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as lower-case hex."""
    return F.sha2(normal_text(text).cast("binary"), 256)


def frequent(keys: DataFrame, digest: str, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """Digests that may be frequent, from Misra-Gries sketches merged in two levels.

    Holds every digest of more than about rows * 4 / (3 * tracked) rows, up to ``candidates``
    of the most frequent; what is missed is merely not removed early.
    """
    part = keys.select(digest, F.floor(F.spark_partition_id() / FAN_IN).alias("_part"))
    level = part.groupBy("_part").agg(F.expr(f"approx_top_k_accumulate({digest}, {tracked})").alias("_sketch"))
    whole = level.groupBy(F.lit(1)).agg(F.expr("approx_top_k_combine(_sketch)").alias("_sketch"))  # no row if empty
    found = whole.select(F.expr(f"inline(approx_top_k_estimate(_sketch, {candidates}))"))
    return found.where("count > 1").select(F.col("item").alias(digest))


def _first(keys: DataFrame) -> DataFrame:
    """Winner and size of each digest, from partial aggregates."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    return keys.groupBy("text_sha256").agg(F.min(order).alias("_first"), F.count("*").alias("group_size"))


def _hot(keys: DataFrame) -> DataFrame:
    """Verified winners of frequent digests: counted in full, not estimated."""
    found = frequent(keys, "text_sha256")
    return _first(keys.join(F.broadcast(found), "text_sha256", "left_semi")).where("group_size > 1")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    keys = write_once(docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256"))
                      .withColumn("_row", F.monotonically_increasing_id()), "digests")
    hot = write_once(_hot(keys), "frequent")
    settled = keys.join(F.broadcast(hot), "text_sha256")
    rest = keys.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
    shuffled = rest.join(_first(rest), "text_sha256")
    return settled.unionByName(shuffled).select(
        "doc_id", F.col("_first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first.row")).alias("kept"),
        "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Copies of frequent texts fall out where they are read, by the broadcast winners; what is
    left is ranked inside its digest, where Spark keeps the first of each partition before the shuffle.
    """
    digest, winner, hot_mark, row = (spare(docs, c) for c in ("_digest", "_keep", "_hot", "_rank"))
    keyed = docs.withColumn(digest, text_digest(F.col("text")))
    keys = write_once(keyed.select("doc_id", F.col(digest).alias("text_sha256"))
                      .withColumn("_row", F.monotonically_increasing_id()), "digests")
    hot = write_once(_hot(keys), "frequent").select(F.col("text_sha256").alias(digest), F.col("_first.id").alias(winner))
    early = keyed.join(F.broadcast(hot.withColumn(hot_mark, F.lit(True))), digest, "left").where(
        F.col(hot_mark).isNull() | F.col("doc_id").eqNullSafe(F.col(winner)))
    order = Window.partitionBy(digest).orderBy(F.col("doc_id").asc_nulls_last(), F.col("text"))
    return early.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*own(docs))


GROUPS_SQL = """
    WITH keyed AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM keyed WINDOW w AS (PARTITION BY text_sha256)
"""
