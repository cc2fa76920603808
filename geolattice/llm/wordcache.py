"""Encodings of distinct words, kept in a Python worker: each word of a batch is looked up by two 64-bit hashes, misses are encoded together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Entries after which a worker starts its cache afresh.
MAX_ENTRIES = 200_000


class WordCache:
    """Numbers by word (token ids, of 32 bits). ``encode`` gets the distinct words missing, by index into the keys asked for, and returns
    the numbers and how many each word has; numbers that 32 bits don't hold are refused."""

    def __init__(self, max_entries: int = MAX_ENTRIES):
        self.max_entries = max_entries
        self._clear()

    def _clear(self) -> None:
        # keys in order, and the entry of each
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.check = np.zeros(1 << 16, np.uint64)
        self.start = np.zeros((1 << 16) + 1, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def _grow(self, entries: int, ids: int) -> None:
        if self.n + entries > len(self.check):
            size = 2 * (self.n + entries)
            self.check = np.resize(self.check, size)
            self.start = np.resize(self.start, size + 1)
        if self.used + ids > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + ids))

    def lookup(self, key: np.ndarray, check: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of all words in order, given their hashes."""
        own, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if self.n + len(own) > self.max_entries:
            self._clear()
        at = np.full(len(own), -1)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            at = np.where(self.keys[place] == own, self.entry[place], -1)
        missing = (at < 0) | (self.check[at] != check[first])
        if missing.any():
            where = np.flatnonzero(missing)
            ids, counts = encode(first[where])
            if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
                raise ValueError("an id needs more than 32 bits")
            self._grow(len(where), len(ids))
            new = np.arange(self.n, self.n + len(where))
            # a key whose second hash differs gets a newer entry, which comes first among equals
            place = np.searchsorted(self.keys, own[where])
            self.keys, self.entry = np.insert(self.keys, place, own[where]), np.insert(self.entry, place, new)
            self.check[new] = check[first[where]]
            self.start[new + 1] = self.used + np.cumsum(counts)
            self.start[self.n] = self.used
            self.ids[self.used : self.used + len(ids)] = ids
            self.n, self.used = self.n + len(where), self.used + len(ids)
            at[where] = new
        at = at[inverse]
        begin, counts = self.start[at], self.start[at + 1] - self.start[at]
        out = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return self.ids[out], counts
