"""Registered queries on training text, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsframe.llm import alignment, bpe, decontaminate, exact_dedup, language, near_dup, packing, pii, prefix_trie, quality, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_exact_dedup", exact_dedup.GROUPS_SQL)
def _(spark, folder):
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


@query("op2_toxicity")
def _(spark, folder):
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_quality")
def _(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_byte_bpe")
def _(spark, folder):
    return bpe.token_digests(table(spark, folder, "documents"))


@query("op4_pii")
def _(spark, folder):
    return pii.span_digests(table(spark, folder, "documents"))


@query("op3_warc", warc.ROUND_TRIP_SQL)
def _(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query("op1_decontaminate", decontaminate.OVERLAPS_SQL)
def _(spark, folder):
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_near_dup")
def _(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op5_language")
def _(spark, folder):
    return language.languages_of(table(spark, folder, "documents"), table(spark, folder, "pages"))


@query("op7_token_counts")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_tokens", "token_score")


@query("op12_best_fit_packing")
def _(spark, folder):
    return packing.pack(table(spark, folder, "documents"), ids=False)


@query("op11_alignment")
def _(spark, folder):
    return alignment.align(table(spark, folder, "documents"), written=False)


@query("op13_prefix_trie")
def _(spark, folder):
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))
