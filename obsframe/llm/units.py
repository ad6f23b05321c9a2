"""Texts as units that no token of either tokenizer crosses, so that each different unit is encoded once.

A unit starts at a blank or line feed that follows a character which is no white space. The byte-level
pattern starts a new piece there, and no piece of the other vocabulary holds a blank or line feed after
another character, so the tokens of a text are those of its units in order. Units that also end in a
character which is no white space may be encoded many at once as one string; the few others are encoded
one by one. All work is on Arrow and numpy arrays of one block of texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import batched, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

BLOCK = 4_000_000    # characters of a block of texts
PART = 1 << 15       # bytes that are encoded as one string
TOGETHER = 16        # strings that a library is given at once: its own records are much larger than the ids
USUAL = "[\n !-~À-ÖØ-öø-ɏ]*"  # line feed, ASCII that is printed, Latin letters: the same classes in every version of Unicode
SOLID = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
SEPARATORS = [chr(c) for c in range(0xFDD0, 0xFDF0)]  # characters that Unicode sets aside for such use
_USUAL = re.compile(USUAL)
JOINT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


def cuts(text: str, size: int) -> Iterator[str]:
    """The whole text in parts of at least ``size`` characters, but for the last, each made of whole units."""
    start = 0
    while start < len(text):
        found = JOINT.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined to blocks whose texts have about ``size`` characters."""
    held, chars = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = lengths[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(lengths, before + size - chars, "right")))
            held.append(batch.slice(first, last - first))
            chars += int(lengths[min(last, batch.num_rows) - 1] - before)
            first = last
            if chars >= size:
                yield _one(held)
                held, chars = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Units:
    """The different units of a block of texts (``fine`` ones, usual characters first, then ``odd`` ones) and each text as codes of these."""

    def __init__(self, texts: pa.Array):
        free = next((s for s in SEPARATORS if not pc.any(pc.match_substring(texts, s)).as_py()), None)
        if free is None:
            parts = pa.array([JOINT.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            parts = pc.split_pattern(pc.replace_substring_regex(texts, f"({SOLID})([ \\n])", f"\\1{free}\\2"), free)
        self.offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        found = parts.flatten().dictionary_encode()
        units = found.dictionary
        fine = pc.and_(pc.match_substring_regex(units, "^[ \\n]"), pc.match_substring_regex(units, f"{SOLID}$")).to_numpy(zero_copy_only=False)
        usual = pc.match_substring_regex(units, f"^{USUAL}$").to_numpy(zero_copy_only=False)
        order = np.argsort(np.where(fine, ~usual, 2), kind="stable")
        place = np.empty(len(units), np.int32)
        place[order] = np.arange(len(units))
        self.codes = place[found.indices.to_numpy()]
        self.fine = units.take(pa.array(order[:fine.sum()]))
        self.odd = units.filter(pa.array(~fine)).to_pylist()

    def __len__(self) -> int:
        return len(self.fine) + len(self.odd)

    def parts(self) -> Iterator[tuple[bytes, np.ndarray]]:
        """Fine units joined to strings of about ``PART`` bytes, with the units' ends in each."""
        if not len(self.fine):
            return
        ends = np.cumsum(pc.binary_length(self.fine).to_numpy()).astype(np.int64)
        _, _, data = self.fine.buffers()
        shift = self.fine.offset and int(pc.sum(pc.binary_length(self.fine.slice(-self.fine.offset))).as_py())
        first, before = 0, 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, before + PART, "right")))
            yield data[shift + before:shift + int(ends[last - 1])].to_pybytes(), ends[first:last] - before
            first, before = last, int(ends[last - 1])


class Rows:
    """Lists of numbers in one array: the list ``i`` is ``values[starts[i]:starts[i + 1]]``."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values, self.starts = values, starts

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` of the lists of all codes one after the other, and where each of these starts."""
        sizes = self.sizes()[codes]
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        return np.repeat(self.starts[codes] - starts[:-1], sizes) + np.arange(starts[-1]), starts


def slices(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about ``most`` items together; ``upto`` counts those before each row."""
    low = 0
    while low < len(upto) - 1:
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + most, "right")) - 1)
        yield low, high
        low = high


class ByteTokens:
    """Byte-level BPE by the ``tokenizers`` library; ``plain`` takes the strings of special tokens as text.

    Texts of ``USUAL`` characters without such strings go through ``tiktoken`` instead, which is several times as fast and merges alike
    where ids rise with the order of merges; a vocabulary in which they do not is left to ``tokenizers`` altogether.
    """

    def __init__(self, path: str, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        special = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = [] if plain else list(special.values())
        shown = _byte_characters()
        vocabulary = sorted((i, t) for t, i in self.library.get_vocab(with_added_tokens=True).items())
        self.tokens = [b""] * (vocabulary[-1][0] + 1)
        for i, token in vocabulary:
            self.tokens[i] = special[i].encode() if i in special else bytes(map(shown.__getitem__, token))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        ranks = {token: i for i, token in enumerate(self.tokens) if token and i not in special}
        self.quick = None
        if _merges_rise(path):
            self.quick = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.quick and _USUAL.fullmatch(text) and not any(s in text for s in self.special):
                out[i] = self.quick.encode_ordinary(text)
            else:
                slow.append(i)
        if slow:
            for i, found in zip(slow, self.library.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = found.ids
        return out


def _merges_rise(path: str) -> bool:
    """Whether the ids of merged tokens rise with the order of the merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(a < b for a, b in pairwise(made)) and not model.get("ignore_merges")


class PieceTokens:
    """Pieces of the ``sentencepiece`` library for texts that start with a blank or line feed."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                       for i in range(self.library.vocab_size()) for p in [self.library.id_to_piece(i)]]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        for token in self.tokens:
            if re.search(rb"[^ \n][ \n]", token):
                raise ValueError(f"the piece {token!r} crosses units")

    def encode(self, texts: list[str]) -> list[list[int]]:
        # the library puts a blank before each text: the letter takes it, as one token
        return [ids[1:] for ids in self.library.encode(["a" + t for t in texts], num_threads=1)]


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printed, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def encode(units: Units, coder: ByteTokens | PieceTokens) -> tuple[Rows, np.ndarray]:
    """The ids of each unit, and which units the tokens do not give back; those have no ids."""
    ids, counts, wrong = [], [], []
    for part, ends, found in _together(units, coder):
        found = np.array(found, np.int64)
        at = np.cumsum(coder.lengths[found])
        upto = np.searchsorted(at, ends, "right")
        if b"".join(map(coder.tokens.__getitem__, found.tolist())) == part and np.array_equal(at[upto - 1], ends):
            ids.append(found)
            counts.append(np.diff(upto, prepend=0))
            wrong.append(np.zeros(len(ends), bool))
        else:
            single = [part[s:e].decode() for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
            _alone(single, coder, ids, counts, wrong)
    _alone(units.odd, coder, ids, counts, wrong)
    sizes = np.concatenate([np.zeros(1, np.int64), *counts])
    return Rows(np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum(sizes)), np.concatenate([np.zeros(0, bool), *wrong])


def _together(units: Units, coder) -> Iterator[tuple[bytes, np.ndarray, list[int]]]:
    for group in batched(units.parts(), TOGETHER):
        found = coder.encode([part.decode() for part, _ in group])
        yield from ((part, ends, ids) for (part, ends), ids in zip(group, found))


def _alone(texts: list[str], coder, ids: list, counts: list, wrong: list) -> None:
    for text, found in zip(texts, coder.encode(texts) if texts else []):
        right = b"".join(map(coder.tokens.__getitem__, found)) == text.encode()
        ids.append(np.array(found if right else [], np.int64))
        counts.append(np.array([len(found) if right else 0], np.int64))
        wrong.append(np.array([not right]))
