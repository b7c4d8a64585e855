"""Words, lines and shingles of many texts at once, as numpy arrays.

A block is the concatenated UTF-8 of some texts. No hash here is a polynomial, whose
collisions are known for any modulus 2**64 and base (Thue-Morse words): bytes are taken
eight at a time, each group is mixed with its place by a bijection that isn't linear, and
the mixed groups are summed; rows of words are hashed as a tree, mixing at every level.
No loop runs over texts or words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import text_offsets

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_LEFT = np.uint64(0xC2B2AE3D27D4EB4F)
#: Of a group of up to eight bytes, those that belong to it.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@lru_cache
def _table(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def summed(values: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each run values[begin : begin + size], of values that are hashes; runs may overlap."""
    out = np.zeros(len(begin), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        n = size[some].astype(np.int64)
        to = np.cumsum(n)
        place = np.arange(to[-1]) - np.repeat(to - n, n)
        mixed = mix(values[place + np.repeat(begin[some], n)] ^ mix((place + (seed << 40)).astype(np.uint64) * _PLACE + _LEFT))
        out[some] = np.add.reduceat(mixed, to - n)
    return mix(out + (size.astype(np.uint64) + np.uint64(1)) * _LENGTH)


def rows_of(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k values in a row: of 1, 2, 4 ... by joining two neighbours."""
    held, have = mix(values + _PLACE), 1
    while have < k:
        step = min(have, k - have)
        held = mix(mix(held[: len(held) - step] * _LEFT + np.uint64(have)) + held[step:])
        have += step
    return held


class TextBlock:
    def __init__(self, column, separators: bytes = b" \t\n\x0b\x0c\r"):
        self.data, self.offsets = text_offsets(column)
        self.n_docs = len(self.offsets) - 1
        n = len(self.data)
        self.space = _table(separators)[self.data]
        start = ~self.space
        end = start.copy()
        first = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        if n:
            inner = start[1:].copy()
            start[1:] &= self.space[:-1]
            start[first] |= ~self.space[first]
            end[:-1] = ~self.space[:-1] & ~inner
            last = first[1:] - 1
            end[last] |= ~self.space[last]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self._groups = None
        self._count()

    def _count(self) -> None:
        #: Words before each document.
        self.first_word = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first_word)
        self.doc_of_word = np.repeat(np.arange(self.n_docs), self.n_words)

    def cut(self, at: np.ndarray) -> None:
        """Begin new words at these places inside words."""
        self.starts = np.sort(np.concatenate([self.starts, at]))
        self.ends = np.sort(np.concatenate([self.ends, at]))
        self._count()

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """The hash of each range of bytes. Two seeds give hashes that are independent of each other."""
        if self._groups is None:
            padded = np.append(self.data, np.zeros(8, np.uint8))
            self._groups = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        size = end - start
        place = _PLACE if not seed else mix(np.array([seed], np.uint64))[0] | np.uint64(1)
        out = mix((self._groups[start] & _MASK[np.minimum(size, 8)]) + place)
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) >> 3
            to = np.cumsum(n)
            number = np.arange(1, to[-1] + 1) - np.repeat(to - n, n)
            at = np.repeat(start[long], n) + 8 * number
            group = self._groups[at] & _MASK[np.minimum(np.repeat(end[long], n) - at, 8)]
            out[long] += np.add.reduceat(mix(group + mix(number.astype(np.uint64) * place)), to - n)
        return mix(out + size.astype(np.uint64) * _LENGTH)

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        return self.hashes(self.starts, self.ends, seed)

    def in_docs(self, mask: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each document has."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offsets])

    def in_words(self, mask: np.ndarray) -> np.ndarray:
        """How many of the marked words each document has."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.first_word])

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each k words in a row of one document."""
        at = np.arange(max(0, len(words) - k + 1))
        if not len(at):
            return at, np.zeros(0, np.uint64)
        at = at[self.doc_of_word[at] == self.doc_of_word[at + k - 1]]
        return at, rows_of(words, k)[at]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the \\n-split lines of the texts that aren't empty."""
        breaks = np.flatnonzero(self.data == 10)
        full = np.flatnonzero(np.diff(self.offsets))
        start = np.sort(np.concatenate([self.offsets[full], breaks + 1]))
        end = np.sort(np.concatenate([self.offsets[full + 1], breaks]))
        # a text that ends in \n has an empty last line, whose start is where the next text starts
        doc = np.repeat(full, np.diff(np.searchsorted(breaks, self.offsets))[full] + 1)
        return start, end, doc


def repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (document, key) rows in order: whether the pair occurs twice or more; its number so far."""
    both = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(0x1234567)))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(ranked)))
    number = np.empty(len(ranked), np.int64)
    number[order] = np.arange(len(ranked)) - np.repeat(at, size)
    many = np.empty(len(ranked), bool)
    many[order] = np.repeat(size > 1, size)
    return many, number
