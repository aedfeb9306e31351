"""Words `[^\\x20\\x09-\\x0D]+` of whole texts and hashes of word sequences, vectorised over a batch of texts.

A word's hash is a polynomial over random values of its bytes, a window's one over the hashes of its words, both modulo
2**64 and finished by a mixer. Sums of prefixes give any window by one subtraction and one product with the inverse
power. Work goes by blocks of bounded size, so memory follows the words of a batch and not a power of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import raw_strings

BLOCK = 1 << 16

_separator = np.zeros(256, bool)
_separator[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

_random = np.random.default_rng(20240229)
_byte_value = _random.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_byte_value_lower = _byte_value[_lower]


def is_separator(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space between words."""
    return _separator[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            for name, value in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, value, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_in_word = _Powers(0x9E3779B97F4A7C15)
_in_window = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


@dataclass
class Words:
    """data: the batch's bytes; start, end: of each word; first: index of each text's first word, and the total."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(column: pa.Array | pa.ChunkedArray) -> Words:
    """Where the words of each text lie; a null has none."""
    data, offsets = raw_strings(column)
    inside = ~_separator[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def word_hashes(words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, of its A-Z as a-z if lower."""
    value, out = _byte_value_lower if lower else _byte_value, np.empty(len(words.start), np.uint64)
    at = 0
    while at < len(out):
        base = int(words.start[at])
        to = max(at + 1, int(np.searchsorted(words.end, base + BLOCK, "right")))
        top = int(words.end[to - 1])
        up, down = _in_word.upto(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(value[words.data[base:top]] * up[:-1], out=sums[1:])
        s, e = words.start[at:to] - base, words.end[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out)


def window_hashes(hashes: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A hash of the n words from each word on, text ends left out of account: len(hashes) - n + 1 values."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out, powers = np.empty(total, np.uint64), _in_window[second]
    for at in range(0, total, BLOCK):
        to = min(total, at + BLOCK)
        up, down = powers.upto(to - at + n)
        sums = np.zeros(to - at + n, np.uint64)
        np.cumsum(hashes[at : to + n - 1] * up[:-1], out=sums[1:])
        out[at:to] = (sums[n:] - sums[:-n]) * down[: to - at]
    return mix(out + np.uint64(n))


def shingles(words: Words, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of n consecutive words; of fewer words, the whole sequence as one."""
    hashes = word_hashes(words, lower)
    windows = window_hashes(hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(windows[a : b - n + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
