"""Language of pages and documents by Bayesian fusion of several kinds of evidence.

* Text: hashed words and character windows of 2 and 3, with likelihoods per language from a bounded sample of labelled
  documents outside the held-out fold (``PER_LANGUAGE`` texts each, of at most ``LONGEST`` characters). Windows of a text
  depend on each other, so it counts as ``EFFECTIVE`` windows at most, at their average.
* Declared language of the markup, and a language code in the address path: the chance of each declaration
  given the language is counted over all items, with the language that their text alone suggests.
* Host: a prior smoothed level by level, host from registered domain, domain from address suffix, suffix from all items, each
  level with the weight of ``SMOOTHING`` items. Its counts are sums of the text's posteriors, from
  partial aggregates over all items; an item's own share is taken out again before its prior is formed.

The posterior is proportional to the product. Documents take part with their ``source`` as host and without
declarations. Every whole text counts. Null and empty texts have no text evidence, items without host share one; an
unknown declaration counts as ``other``, a missing one is no evidence. Null ids are carried, repeated rows count as items of their own; ties
go to the language that is first in the alphabet. Without labelled documents there is no language to choose and ``lang`` is null. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.folds import held_out
from obsframe.llm.windows import Hasher, blocks
from obsframe.session import write_once

BITS = 16
GRAMS = (2, 3)
PER_LANGUAGE = 400
LONGEST = 20_000
MOST_LANGUAGES = 200
EFFECTIVE = 60
SMOOTHING = 5.0


def _buckets(block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    shift = np.uint64(64 - BITS)
    for at, hashes in (block.words(), *(block.grams(n) for n in GRAMS)):
        yield at, (hashes >> shift).astype(np.int64)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the logarithm of each bucket's chance in each, from a bounded sample of labelled documents."""
    usable = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= LONGEST))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for lang, size in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (place < PER_LANGUAGE / size))

    def counted(batches):
        hasher, totals = Hasher(), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total = totals.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for _, parts in blocks([text.lower()]):
                    for _, which in _buckets(hasher.block(parts)):
                        total += np.bincount(which, minlength=1 << BITS)
        for lang, total in totals.items():
            yield pd.DataFrame({"lang": lang, "bucket": np.flatnonzero(total), "n": total[total > 0]})

    rows = usable.where(wanted).mapInPandas(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    found = rows.toPandas()
    logs = np.zeros((1 << BITS, len(languages)), np.float32)
    for j, lang in enumerate(languages):
        some = found[found["lang"] == lang]
        total = np.full(1 << BITS, 0.5)
        total[some["bucket"].to_numpy(np.int64)] += some["n"].to_numpy(float)
        logs[:, j] = np.log(total / total.sum())
    return languages, logs


def text_evidence(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Log likelihood of each whole text in each language, as ``EFFECTIVE`` windows at most."""
    hasher, lower = Hasher(), [t.lower() for t in texts]
    total, count = np.zeros((len(texts), logs.shape[1])), np.zeros(len(texts))
    for owners, parts in blocks(lower):
        block = hasher.block(parts)
        for at, which in _buckets(block):
            np.add.at(count, owners, block.per_part(at, np.ones(len(at))))
            for j in range(logs.shape[1]):
                np.add.at(total[:, j], owners, block.per_part(at, logs[which, j]))
    return total / np.maximum(count, 1)[:, None] * np.minimum(count, EFFECTIVE)[:, None]


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, hinted, host, domain, suffix from addresses and markup."""
    html = F.coalesce("html", F.lit(""))
    hidden = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    return pages.select(
        "page_id", F.regexp_replace(hidden, r"<[^>]*>", " ").alias("text"),
        F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)).alias("declared"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/]*//[^/]*/([A-Za-z]{2})(?:[/?#-]|$)", 1)).alias("hinted"),
        host.alias("host"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"))


def document_items(docs: DataFrame) -> DataFrame:
    source = F.coalesce("source", F.lit(""))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("declared"), F.lit("").alias("hinted"),
                       source.alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))


def _softmax(logs: Column) -> Column:
    top = F.transform(F.array(logs), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))[0]
    return F.transform(F.array(top), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))[0]


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _declarations(items: DataFrame, column: str, languages: list[str]) -> Column:
    """Log chance of an item's declaration in each language, counted over all items; at most one row per pair of languages is collected."""
    value = F.when(F.col(column).isin(languages), F.col(column)).otherwise("other")
    rows = items.where(F.col(column) != "").groupBy(value.alias("value"), F.col("text_lang")).count().collect()
    counts = {(r["value"], r["text_lang"]): r["count"] for r in rows}
    values = [*languages, "other"]
    out = F.array(*(F.lit(0.0) for _ in languages))
    for v in values:
        logs = [math.log((counts.get((v, lang), 0) + 1) / (sum(counts.get((w, lang), 0) for w in values) + len(values))) for lang in languages]
        out = F.when((F.col(column) != "") & (value == v), F.array(*map(F.lit, logs))).otherwise(out)
    return out


def identify(items: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The other columns of ``items`` with ``lang``, ``probability`` and ``text_lang``."""
    languages, logs = model
    size = len(languages)
    ids = [c for c in items.columns if c not in ("text", "declared", "hinted", "host", "domain", "suffix")]
    if not size:
        return items.select(*ids, *(F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("probability", "double"), ("text_lang", "string"))))
    shared = items.sparkSession.sparkContext.broadcast(logs)

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(text_evidence(texts.tolist(), shared.value)), dtype=object)

    def choice(chances: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, languages)), F.array_position(chances, F.array_max(chances)).cast("int"))

    read = items.select(*ids, "declared", "hinted", "host", "domain", "suffix", evidence(F.col("text")).alias("text_logs"))
    read = write_once(read.withColumn("chances", _softmax(F.col("text_logs"))).withColumn("text_lang", choice(F.col("chances"))), "evidence")

    sums = [F.sum(F.col("chances")[j]).alias(f"s{j}") for j in range(size)]
    again = [F.sum(f"s{j}").alias(f"s{j}") for j in range(size)]
    hosts = write_once(read.groupBy("suffix", "domain", "host").agg(*sums), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(*again)
    suffixes = domains.groupBy("suffix").agg(*again)
    whole = suffixes.agg(*again).first()
    everything = [whole[j] or 0.0 for j in range(size)]

    def packed(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.select(*keys, F.array(*(F.col(f"s{j}") for j in range(size))).alias(name))

    levels = packed(hosts, "by_host", "suffix", "domain", "host").join(packed(domains, "by_domain", "suffix", "domain"), ["suffix", "domain"]).join(
        packed(suffixes, "by_suffix", "suffix"), "suffix")
    joined = read.join(levels, ["suffix", "domain", "host"])
    prior = F.transform(F.array(*(F.lit((n + 1) / (sum(everything) + size)) for n in everything)), lambda x: x)
    for number, level in enumerate(("by_suffix", "by_domain", "by_host")):
        joined = joined.withColumn("_prior", prior if not number else F.col("_prior")).withColumn("_rest", F.zip_with(
            level, "chances", lambda n, p: F.greatest(n - p, F.lit(0.0))))
        total = F.aggregate("_rest", F.lit(0.0), lambda a, x: a + x)
        joined = joined.withColumn("_total", total).withColumn("_prior", F.zip_with(
            "_rest", "_prior", lambda n, p: (n + SMOOTHING * p)))
        joined = joined.withColumn("_prior", F.transform("_prior", lambda x: x / (F.col("_total") + SMOOTHING)))
    fused = _plus(_plus(F.col("text_logs"), F.transform("_prior", lambda x: F.log(x))),
                  _plus(_declarations(read, "declared", languages), _declarations(read, "hinted", languages)))
    out = joined.withColumn("posterior", _softmax(fused))
    return out.select(*ids, choice(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), "text_lang")


def languages_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_id, lang, probability, text_lang: one row per document and per page."""
    items = document_items(docs).unionByName(page_items(pages), allowMissingColumns=True)
    return identify(items, fit(docs)).select("doc_id", "page_id", "lang", "probability", "text_lang")
