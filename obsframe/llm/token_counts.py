"""Numbers of tokens under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton finds all vocabulary pieces that end at a character, and dynamic programming over the
characters carries the best score and the number of pieces on the best path. Rules of the tokenizer:

* A blank is written as ``▁``, and one is put before the text (an empty text has no tokens); nothing else is changed.
* The best path has the largest sum of scores. A path replaces an earlier one only if it is strictly better, where
  paths into a character are tried by the start of their last piece: among equals the longest last piece wins.
* A character that is no piece by itself may also be taken as unknown, at the lowest score less 10; it is written as its bytes, one token each.

Pieces and scores are those of a model file. Pieces without a score of their own (``NO_SCORE`` or less) and the file's
control, unknown and byte pieces take no part, but a single blank without one has the lowest of the others. Scores there are whole numbers, so sums are exact in any
order; a library that adds in single precision agrees as long as its sums stay below 2 ** 24. No piece holds a blank after its
first character, so a text falls apart before each blank, and its words are counted one by one and remembered.

A null text is empty and has no tokens. Rows are counted by themselves: null or repeated ids and
extra columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
NO_SCORE = -1e8
PENALTY = 10
HELD = 300_000     # words of a generation that a task remembers
TOGETHER = 500     # texts in one step


def read_pieces(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a model file; the file's size bounds what is broadcast."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    found = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
    found = {piece: score for piece, score in found.items() if score > NO_SCORE}
    found.setdefault("▁", min(found.values()))
    if any("▁" in piece[1:] for piece in found):
        raise ValueError("a piece holds a blank after its first character")
    return found


class Counter:
    """Best paths of words."""

    def __init__(self, pieces: dict[str, float]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(pieces.values()) - PENALTY
        self.known: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best path."""
        scores, counts, unknown = [0.0], [0], self.unknown
        end, best, count, single = 0, None, 0, False
        for found, (length, score) in self.matches.iter(word):  # by end, those of one end from the longest, which starts first
            while end < found:
                if not single and (best is None or scores[end] + unknown > best):
                    best, count = scores[end] + unknown, counts[end] + len(word[end].encode())
                scores.append(best)
                counts.append(count)
                end, best, count, single = end + 1, None, 0, False
            value = scores[end + 1 - length] + score
            if best is None or value > best:
                best, count = value, counts[end + 1 - length] + 1
            if length == 1:
                single = True
        while end < len(word):
            if not single and (best is None or scores[end] + unknown > best):
                best, count = scores[end] + unknown, counts[end] + len(word[end].encode())
            scores.append(best)
            counts.append(count)
            end, best, count, single = end + 1, None, 0, False
        return counts[-1], scores[-1]

    def count(self, texts: list[list[str]]) -> list[tuple[int, float]]:
        """Tokens and scores of texts that are given as lists of words.

        Words are remembered in two generations: when the newer one is full the older one is forgotten, and words that come again move up.
        """
        present = set().union(*texts)
        known, older = self.known, self.older
        for word in present:
            if word not in known:
                known[word] = older.get(word) or self.best(word)
        found = [[known[w] for w in words] for words in texts]
        if len(known) > HELD:
            self.known, self.older = {}, known
        return [(sum(n for n, _ in rows), sum(s for _, s in rows)) for rows in found]


def words(text: str) -> list[str]:
    """The text with its blanks written out, apart before each of them."""
    return WORD.findall("▁" + text.replace(" ", "▁")) if text else []


WORD = regex.compile("▁[^▁]*")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs``, ``n_tokens`` and ``token_score``; existing columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path or public_tokenizers.path(MODEL)))
    made = ["n_tokens", "token_score"]
    keep = [c for c in docs.columns if c.lower() not in made]
    plain = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce("text", F.lit(""))).toDF(*(f"c{i}" for i in range(len(keep))), "text")
    fields = plain.schema.fields[:-1] + [T.StructField("m0", T.LongType()), T.StructField("m1", T.DoubleType())]

    def counted(batches):
        counter = Counter(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                found = counter.count([words(t) for t in part.column("text").to_pylist()])
                new = [pa.array([n for n, _ in found], pa.int64()), pa.array([float(s) for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + new, [f.name for f in fields])

    return plain.mapInArrow(counted, T.StructType(fields)).toDF(*keep, *made)
