"""Vectorised word scanning and hashing of Arrow text columns, for use inside Spark tasks.

A column's UTF-8 buffer is read in place; words, windows and hashes are NumPy arrays over it, so that
no Python object is made per word. Hashes are 64 bits: a keyed polynomial over the bytes of a word,
finished by a mixer, and the same again over the words of a window.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; one longer document is a slice of its own.
SLICE_BYTES = 1 << 18
U = np.uint64


def _lut(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[np.frombuffer(separators, np.uint8)] = False
    return t


#: Words are runs of anything but these ASCII white-space characters.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SPACED = _lut(SPACE)
#: Words are runs of ASCII letters and digits and of all other characters above 0x7F.
ALNUM = _lut(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Lower-cases A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher that makes every bit depend on every other (the 64-bit finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class _Base:
    """Powers of an odd base modulo 2**64 and of its inverse, made once in each Python worker and extended as needed."""

    def __init__(self, seed: int):
        self.base = int(np.random.default_rng(seed).integers(1 << 62, dtype=np.int64)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // STEP) * STEP
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


#: Places by which the powers grow.
STEP = 1 << 16
#: Two bases serve all seeds, so that their powers are few; seeds differ by what stands for a byte.
_BASES = [_Base(1), _Base(2)]


class _Powers:
    def __init__(self, seed: int):
        self.own = _BASES[seed % 2]
        self.base, self.to = self.own.base, self.own.to
        self.table = np.random.default_rng(1000 + seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


_POWERS: dict[int, _Powers] = {}


def _powers(seed: int) -> _Powers:
    if seed not in _POWERS:
        _POWERS[seed] = _Powers(seed)
    return _POWERS[seed]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of data[start:end] for each pair; data are bytes."""
    p = _powers(seed)
    up, down = p.to(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(p.table[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; len(words) - width + 1 of them (none if there are fewer words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    p = _powers(seed + 7920)
    up, down = p.to(len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


_TRIMMED = [0.0]


def trim(seconds: float = 1.0) -> None:
    """Gives memory that is free back to the system, at most once in so many seconds: Spark keeps a Python worker for later stages."""
    if time.monotonic() - _TRIMMED[0] < seconds:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
    _TRIMMED[0] = time.monotonic()


@dataclass
class Slice:
    """Some consecutive documents of a batch: their bytes, and where each begins in them (one more at the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The text column in slices of about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    size = 8 if wide else 4
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1, column.offset * size).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
        trim()


@dataclass
class Words:
    """Words of a slice in order: byte spans and the document each is in; ``begin[d]`` is the first word of document d."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    begin: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.begin)


def words(s: Slice, is_word: np.ndarray = SPACED) -> Words:
    """Maximal runs of word bytes; none crosses documents."""
    m = is_word[s.data]
    n = len(m)
    start, end = m.copy(), m.copy()
    if n:
        start[1:] &= ~m[:-1]
        end[:-1] &= ~m[1:]
        edge = s.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        start[edge] = m[edge]
        end[edge - 1] = m[edge - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    begin = np.searchsorted(a, s.offsets)
    return Words(a, b, np.repeat(np.arange(s.n), np.diff(begin)), begin)


def whole_windows(w: Words, width: int) -> np.ndarray:
    """Indexes of the words at which a window of ``width`` words of one document starts."""
    n = len(w.start)
    if n < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.doc[: n - width + 1] == w.doc[width - 1 :])


def covered(n: int, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a run of ``width`` places that begins at one of ``at``."""
    return np.cumsum((np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1))[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    d = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
