"""What a Python worker keeps between tasks: one operator's model, and pieces of words in arrays of fixed size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import release

_HELD: dict[tuple, object] = {}


def only(key: tuple, make: Callable[[], object]):
    """The worker's model for key, made if it isn't there; models of other operators are let go."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Let go what an operator before this one left in the worker."""
    if _HELD:
        _HELD.clear()
        release()


class WordCache:
    """Pieces of words met before: a table of so many places, never more; of 33 bytes each for a vocabulary of up to 65,536.

    A word has one place, told by its hash, and takes it from the word that was there. Two hashes
    of 64 bits, independent of each other, must agree. Words of more than WIDTH pieces are not kept.
    """

    WIDTH = 8

    def __init__(self, vocabulary: int = 1 << 31, slots: int = 1 << 21) -> None:
        self.slots = slots
        self.key = np.zeros(slots, np.uint64)
        self.check = np.zeros(slots, np.uint64)
        self.size = np.zeros(slots, np.int8)
        self.held = np.zeros((slots, self.WIDTH), np.uint16 if vocabulary <= 1 << 16 else np.int32)

    def pieces(self, key: np.ndarray, check: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
        """(place of each word's pieces, their number, pieces) of distinct words. `learn` gives (numbers, pieces) of those at some indices."""
        slot = (key & np.uint64(self.slots - 1)).astype(np.int64)
        known = (self.key[slot] == key) & (self.check[slot] == check) & (self.size[slot] > 0)
        size = np.where(known, self.size[slot], 0).astype(np.int64)
        new = np.flatnonzero(~known)
        flat = np.zeros(0, np.int32)
        if len(new):
            own, flat = learn(new)
            flat = flat.astype(np.int32, copy=False)
            size[new] = own
        old = np.flatnonzero(known)
        begin = np.zeros(len(key), np.int64)
        to = np.cumsum(size[new])
        begin[new] = to - size[new]
        before = np.cumsum(size[old])
        begin[old] = len(flat) + before - size[old]
        kept = self.held[slot[old]][np.arange(self.WIDTH) < size[old][:, None]]
        out = np.concatenate([flat, kept.astype(np.int32, copy=False)])
        fits = new[(size[new] > 0) & (size[new] <= self.WIDTH)]
        if len(fits):
            # of new words with one place the last stays; all arrays are set for the same one
            fits = fits[np.unique(slot[fits][::-1], return_index=True)[1] * -1 + len(fits) - 1]
            at = slot[fits]
            self.key[at], self.check[at], self.size[at] = key[fits], check[fits], size[fits]
            inside = np.arange(self.WIDTH) < size[fits][:, None]
            rows = np.zeros((len(fits), self.WIDTH), self.held.dtype)
            rows[inside] = out[(begin[fits][:, None] + np.arange(self.WIDTH))[inside]]
            self.held[at] = rows
        return begin, size, out
