"""Benchmark passages in documents, by spaced seeds.

Texts are lower-cased words (runs of letters and digits). A mask selects some of the tokens of a
window and ignores the rest; the hash of the selected tokens is a seed. Seeds of all benchmark
positions are joined to the seeds of all document positions, and around each hit the two texts are
compared word by word on the hit's diagonal. A document holds a passage of an item if, on one diagonal,
some ``window(n)`` consecutive tokens of the item of ``n`` tokens differ from the document's in at most
``allowed(window)`` places: 20 tokens and 4 substitutions, fewer for shorter items. For every window of 10 to
20 tokens the three masks have a placement that avoids any such set of substitutions (checked by enumeration in the tests), so the search is
lossless. Items of fewer than 8 words are no evidence and match nothing; of 8 and 9 words they must match exactly.

Only DataFrame functions are used. Benchmark seeds are broadcast in blocks of at most ``BLOCK_WORDS``
words; the usual benchmark is one block, a larger one reads the documents once per block. A hit carries
only the words around it, so no text is shuffled.

Null texts are empty and hold nothing. Repeated benchmark rows count once. Documents that share an id
share their rows in ``overlaps``; ``clean`` decides by id and text. Null ids are ids like
others. Empty tables give empty overlaps, and ``clean`` then keeps everything. Extra columns are carried by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.columns import own, spare

# Offsets of the tokens that each mask selects.
MASKS = [(0, 1, 2, 3, 5), (0, 2, 3, 6, 7), (0, 3, 5, 6, 7)]
SPAN = 8
LEAST = min(max(m) for m in MASKS) + 1    # tokens that the shortest mask spans
LONGEST, SHORTEST = 20, 10
BLOCK_WORDS = 1_000_000    # about 100 MB of seeds and words in a broadcast


def window(words: int) -> int:
    return min(LONGEST, words)


def allowed(size: int) -> int:
    return size // 5 if size >= SHORTEST else 0


def word_list(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _seeds(df: DataFrame, words: str, carried: list[str]) -> DataFrame:
    """One row (carried columns, ``at``, ``seed``) per position and mask; the position is where the window starts."""
    size = F.size(words)
    positions = F.explode(F.when(size >= SPAN, F.sequence(F.lit(0), size - LEAST))).alias("at")

    def seed(number: int, mask: tuple[int, ...]) -> Column:
        picked = [F.get(words, F.col("at") + offset) for offset in mask]
        return F.when(F.col("at") + mask[-1] < F.size(words), F.xxhash64(F.lit(number), *picked))

    placed = df.select(*dict.fromkeys([*carried, words]), positions)
    return placed.select(*carried, "at", F.explode(F.array(*(seed(i, m) for i, m in enumerate(MASKS)))).alias("seed")).where(
        "seed is not null")


def _items(benchmark: DataFrame) -> DataFrame:
    listed = benchmark.select("item_id", word_list(F.col("text")).alias("item_words")).where(F.size("item_words") >= SPAN).distinct()
    return listed.withColumn("item", F.xxhash64("item_id", F.array_join("item_words", " ")))


def _best(doc: Column, doc_at: Column, item: Column, item_at: Column, doc_first: Column, doc_size: Column) -> Column:
    """Most equal tokens in a window around a hit, or null if no window has enough.

    ``doc`` holds the document's words from ``doc_first`` on, enough for every window that holds the seed.
    """
    size = F.least(F.lit(LONGEST), F.size(item))
    need = size - F.when(size >= SHORTEST, F.floor(size / 5)).otherwise(0)
    shift = doc_at - item_at
    first = F.greatest(item_at + LEAST - size, -shift, F.lit(0))
    last = F.least(item_at + size, F.size(item), doc_size - shift) - 1

    def equal(j: Column) -> Column:
        return F.when(F.get(doc, j + shift - doc_first) == F.get(item, j), 1).otherwise(0)

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def best(marks: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.size(marks) - size + 1), lambda s: add(F.slice(marks, s, size)))
        return F.when((F.size(marks) >= size) & (add(marks) >= need), F.array_max(sums))

    marks = F.when(last - first + 1 >= size, F.transform(F.sequence(first, last), equal))
    found = F.transform(F.array(marks), best)[0]
    return F.when(found >= need, found)


def _hits(docs: DataFrame, items: DataFrame, carried: list[str]) -> DataFrame:
    seeds = _seeds(items, "item_words", ["item"]).withColumnRenamed("at", "item_at")
    placed = _seeds(docs, "_words", [*carried, "_words"])
    met = placed.join(F.broadcast(seeds), "seed")
    first = F.greatest(F.col("at") - LONGEST, F.lit(0))
    near = met.select(*carried, "at", "item", "item_at", first.alias("first"), F.size("_words").alias("size"),
                      F.slice("_words", first + 1, F.lit(2 * LONGEST + SPAN)).alias("near"))
    known = near.join(F.broadcast(items), "item")
    best = _best(F.col("near"), F.col("at"), F.col("item_words"), F.col("item_at"), F.col("first"), F.col("size"))
    return known.select(*carried, "item_id", F.least(F.lit(LONGEST), F.size("item_words")).alias("window"), best.alias("matched")).where(
        "matched is not null")


def _search(docs: DataFrame, benchmark: DataFrame, carried: list[str]) -> DataFrame:
    items = _items(benchmark)
    total = items.agg(F.sum(F.size("item_words"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    worded = docs.withColumn("_words", word_list(F.col("text")))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod("item", F.lit(blocks)) == block) if blocks > 1 else items
        hits = _hits(worded, part, carried)
        found = hits if found is None else found.unionByName(hits)
    return found


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, window: documents and the items of which they hold a passage."""
    hits = _search(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    return hits.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item, with their own columns."""
    number = spare(docs, "_text")
    keyed = docs.withColumn(number, F.xxhash64("text"))
    hits = _search(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")), benchmark, ["doc_id", "_text"])
    held = hits.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).distinct()
    kept = keyed.join(held, keyed["doc_id"].eqNullSafe(held["_id"]) & (keyed[number] == held["_hash"]), "left_anti")
    return kept.select(*own(docs))


_WORDS_SQL = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
OVERLAPS_SQL = f"""
    WITH docs AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
    items AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS words FROM benchmark),
    sized AS (SELECT *, least(20, len(words)) AS size, CASE WHEN len(words) >= 10 THEN least(20, len(words)) // 5 ELSE 0 END AS free
              FROM items WHERE len(words) >= 8),
    doc_words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
    item_words AS (SELECT item_id, size, free, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM sized),
    -- a window with one difference in five tokens at most has three equal tokens in a row
    doc_threes AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS three
                   FROM doc_words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    item_threes AS (SELECT item_id, pos, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS three
                    FROM item_words WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
    diagonals AS (SELECT DISTINCT doc_id, item_id, d.pos - i.pos AS shift FROM doc_threes d JOIN item_threes i USING (three)),
    compared AS (SELECT g.doc_id, g.item_id, g.shift, i.size, i.free, i.pos, CASE WHEN i.word = d.word THEN 1 ELSE 0 END AS equal
                 FROM diagonals g JOIN item_words i USING (item_id) JOIN doc_words d ON d.doc_id = g.doc_id AND d.pos = i.pos + g.shift),
    summed AS (SELECT *, sum(equal) OVER w AS total, count(*) OVER w AS held FROM compared
               WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
    SELECT doc_id, item_id, CAST(max(CASE WHEN size = 20 THEN total ELSE matched END) AS INTEGER) AS matched, CAST(max(size) AS INTEGER) AS "window"
    FROM (SELECT *, sum(equal) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS matched,
                 count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM summed)
    WHERE CASE WHEN size = 20 THEN held = 20 AND total >= 20 - free ELSE rest = size AND matched >= size - free END
    GROUP BY doc_id, item_id
"""
