"""Words of whole Arrow columns as numpy arrays, hashed without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = (1 << 20) - 1024
"""Text of about this many bytes is worked on at once; one longer text is a slice of its own."""

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.ones(256, bool)
_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACED = "spaced"
"""Words are runs of bytes other than ASCII white space; letters stay as they are."""
SPACED_LOWER = "spaced_lower"
"""As SPACED, with A-Z lower-cased."""
ALNUM_LOWER = "alnum_lower"
"""Words are runs of a-z, 0-9 and bytes above ASCII, with A-Z lower-cased first."""


def _values(seed: int, lower: bool) -> np.ndarray:
    v = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return v[_LOWER] if lower else v


_RULES = {SPACED: (_SPACE, False), SPACED_LOWER: (_SPACE, True), ALNUM_LOWER: (_ALNUM[_LOWER], True)}
_TABLES = {(r, lane): _values(77 + lane, _RULES[r][1]) for r in _RULES for lane in (0, 1)}
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_SHINGLE_BASES = [np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)]


@lru_cache(maxsize=16)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to ``size``."""
    def run(b):
        a = np.full(size + 1, b, np.uint64)
        a[0] = 1
        return np.multiply.accumulate(a)

    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: np.uint64, size: int):
    up = 1 << max(12, int(size).bit_length())
    return _powers(int(base), up)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: byte places in ``data`` and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word offsets of the texts, one more than texts
    rule: str
    offsets: np.ndarray  # byte offsets of the texts

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the two lanes are independent."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        up, down = powers(_BASES[lane], len(self.data) + 1)
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLES[self.rule, lane][self.data] * up[: len(self.data)], out=run[1:])
        return mix((run[self.end] - run[self.start]) * down[self.start])

    def of(self, i: int) -> bytes:
        """Text ``i`` as its words joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        return b" ".join(
            self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])
        )


def shingle_sums(hashes: np.ndarray, lane: int = 0):
    """A function (start, width) -> hash of that many words; start may be an array."""
    up, down = powers(_SHINGLE_BASES[lane], len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=run[1:])
    return lambda start, width: (run[start + width] - run[start]) * down[start]


def find_words(data: np.ndarray, offsets: np.ndarray, rule: str) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; no word spans two texts."""
    inside = _RULES[rule][0][data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False  # a text starts outside of a word
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), rule, offsets)


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into slices (first row, last row, bytes, offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_slices(column, rule: str) -> Iterator[tuple[int, int, Words]]:
    """As text_slices, with the words found."""
    for at, to, data, offsets in text_slices(column):
        yield at, to, find_words(data, offsets, rule)


def window_starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``width`` words, and the text each lies in."""
    counts = np.maximum(words.counts() - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(len(text)) + begin, text
