"""Words of texts as 64-bit hashes, computed on whole Arrow batches.

A word is a run of bytes other than space and U+0009 to U+000D, which is the pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8. Its hash
is a polynomial in random byte codes, taken from running sums, so no Python object is made per word. Equal words have equal
hashes in every task and run; the constants below are part of what "equal" means.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_KEPT_POWERS = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... modulo 2^64, n of them at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if len(have) <= _KEPT_POWERS:
            _POWERS[base] = have
    return have


def slice_hashes(codes: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice [start, end) of codes, in time linear in codes and slices."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(base, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts])


class Words(NamedTuple):
    """Words of some documents: hash of each, and where each document's begin (one entry more than documents)."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (as a word index) and hash of each run of n words inside one document."""
        at = window_starts(self.bounds, n)
        return at, slice_hashes(self.hashes, _WORD_BASE, at, at + n)


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Word indices from which n words of the same document follow."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[0], bounds[-1])
    return np.flatnonzero(left >= n) + bounds[0]


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of words [start, end)."""
    return slice_hashes(hashes, _WORD_BASE, starts, ends)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start and end; none goes on from one document to the next."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """data: UTF-8 of the documents one after the other; offsets: where each begins, and the end. lower: A to Z become a to z."""
    data = _LOWER[data] if lower else data
    starts, ends = _runs(_IN_WORD[data], offsets)
    return Words(slice_hashes(_CODES[data], BYTE_BASE, starts, ends), np.searchsorted(starts, offsets), starts, ends, data)


def give_back() -> None:
    """Hand memory that a worker has freed back to the system; workers live on between tasks and share a machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_chunks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of groups of rows that hold some CHUNK_BYTES together; a longer text is a group of
    its own and is still taken whole."""
    data, offsets = utf8(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield row, end, split_words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower)
        row = end
    give_back()


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lower_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Codes of the lower-cased bytes with starts and ends of the runs of letters, and the first run of each document."""
    starts, ends = _runs(_LETTERS[data], offsets)
    return (_CODES[_LOWER[data]], starts, ends), np.searchsorted(starts, offsets)
