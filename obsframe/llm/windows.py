"""Hashes of words and character windows, for whole blocks of texts at once.

One running sum of ``code point * BASE ** position`` (modulo 2 ** 64) gives the hash of any
substring with one subtraction and one product, so a block of texts is hashed by a few
array operations. Texts of any length are worked through in pieces that end at white
space; a word longer than ``BLOCK`` characters is cut. Memory is that of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


def pieces(text: str, size: int = BLOCK) -> Iterator[str]:
    """The whole text in parts of at most ``size`` characters, cut at white space where there is some."""
    start = 0
    while len(text) - start > size:
        cut = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size))
        end = cut if cut > start else start + size
        yield text[start:end]
        start = end
    yield text[start:]


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of all texts in order, as blocks of about ``size`` characters, with the text each part belongs to."""
    owners, parts, held = [], [], 0
    for owner, text in enumerate(texts):
        for part in pieces(text, size):
            if parts and held + len(part) + 1 > size:
                yield owners, parts
                owners, parts, held = [], [], 0
            owners.append(owner)
            parts.append(part)
            held += len(part) + 1
    if parts:
        yield owners, parts


class Hasher:
    """Holds the powers of the base; one per task."""

    def __init__(self, size: int = 2 * BLOCK + 16):
        one = np.ones(1, np.uint64)
        self.up = np.concatenate([one, np.cumprod(np.full(size, BASE, np.uint64))])
        self.down = np.concatenate([one, np.cumprod(np.full(size, pow(BASE, -1, 2 ** 64), np.uint64))])

    def block(self, parts: list[str]) -> Block:
        return Block(self, parts)


class Block:
    """A block of parts, each between two single blanks; a window belongs to the part it starts in."""

    def __init__(self, hasher: Hasher, parts: list[str]):
        points = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "replace"), np.uint32)
        self.blank = (points <= 32) | (points == 0xA0) | (points == 0x3000)
        self.down, self.size = hasher.down, len(points)
        terms = np.where(self.blank, np.uint64(1), points.astype(np.uint64) + np.uint64(1)) * hasher.up[:self.size]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        self.blanks = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.blank, dtype=np.int32)])
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)[:-1]])

    @staticmethod
    def mixed(hashes: np.ndarray, kind: int) -> np.ndarray:
        hashes = (hashes ^ np.uint64(kind)) * np.uint64(MIX)
        return (hashes ^ (hashes >> np.uint64(32))) * np.uint64(MIX)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of windows of ``n`` (2 or more) characters inside a word, which counts the blank on either side."""
        count = self.size - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inner = self.blanks[n - 1:n - 1 + count] - self.blanks[1:1 + count]
        at = np.flatnonzero(inner == 0)
        return at, self.mixed((self.sums[at + n] - self.sums[at]) * self.down[at], n)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of words."""
        edge = np.diff(self.blank.astype(np.int8))
        first, last = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        return first, self.mixed((self.sums[last] - self.sums[first]) * self.down[first], 1)

    def per_part(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` by the part their positions fall into."""
        part = np.searchsorted(self.starts, at, side="right") - 1
        return np.bincount(part, weights=values, minlength=len(self.starts))

    def part_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1
