"""Vectorised word hashing for batches of texts.

Words are runs of letters, digits and combining marks by Unicode category, lower-cased character by character. Characters of scripts that are written
without spaces (Han, Kana, Thai, Lao, Khmer, Myanmar and their like) are words of one letter each. A word's 64-bit hash is the sum of its characters, each
multiplied by an odd number that belongs to the character's place, and a last mix: every character of a word of any length counts, and so does the order.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Blocks of Unicode whose scripts put no spaces between words (first, last).
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x323AF),
)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def fold_table() -> np.ndarray:
    """By code point: 0 if no part of a word, else its lower case; the top bit marks characters that are words of their own."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LMN":
            out[c] = ord(chr(c).lower()[0])
    for first, last in UNSPACED:
        held = out[first : last + 1]
        held[held > 0] |= np.uint32(1 << 31)
    return out


def places(n: int) -> np.ndarray:
    """An odd multiplier for each place in a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


@dataclass
class Words:
    """Words of several texts in a row. ``offsets[i]:offsets[i+1]`` are text i's words; ``raw`` has code points, one more per text than it has."""

    offsets: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    raw: np.ndarray
    raw_offsets: np.ndarray

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the words' first n characters (shorter words: the whole)."""
        cut = np.minimum(self.lengths, n)
        running = np.zeros(len(self.lengths), dtype=np.uint64)
        by = places(n)
        for i in range(n):
            has = np.flatnonzero(cut > i)
            running[has] += (fold_table()[self.raw[self.starts[has] + i]] & np.uint32(0x7FFFFFFF)).astype(np.uint64) * by[i]
        return mix(running ^ np.uint64(n))


def hash_words(texts: list[str | None]) -> Words:
    data = [t or "" for t in texts]
    raw_offsets = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])]).astype(np.int64)
    raw = np.frombuffer(("\n".join(data) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4") if data else np.zeros(0, np.uint32)
    folded = fold_table()[raw]
    inside = folded != 0
    alone = folded >> np.uint32(31)
    # a word begins where a run begins, at each character that stands alone and after it
    first = inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1] | (alone[1:] | alone[:-1]).astype(bool)
    starts = np.flatnonzero(first)
    offsets = np.searchsorted(starts, raw_offsets)
    at = np.flatnonzero(inside)
    if not len(starts):
        return Words(offsets, starts, starts, np.zeros(0, np.uint64), raw, raw_offsets)
    begin = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    terms = (folded[at] & np.uint32(0x7FFFFFFF)).astype(np.uint64) * places(int(lengths.max()))[place]
    return Words(offsets, starts, lengths, mix(np.add.reduceat(terms, begin)), raw, raw_offsets)


def slices(column, max_chars: int = 2_000_000):
    """Cut strings (an Arrow column or a list) into runs (start, list) of about ``max_chars`` characters, to bound memory."""
    run, start, size = [], 0, 0
    for i, t in enumerate(column if isinstance(column, list) else column.to_pylist()):
        run.append(t)
        size += len(t or "")
        if size >= max_chars:
            yield start, run
            run, start, size = [], i + 1, 0
    if run:
        yield start, run
