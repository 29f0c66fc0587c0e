"""Substring dedup with an FM-index per shard: backward search over a wavelet matrix gives matching statistics.

A shard's distinct segments are one text with a separator after each; a segment that has copies is in it twice. The index is the
Burrows-Wheeler transform in a wavelet matrix of packed bits, with the lengths of common prefixes of neighbours for shortening a
match (Ohlebusch, Gog and Kuegell, 2010). All segments are streamed against it at once, from right to left; of each position the
longest match that occurs twice is found, and matches of a window's length or more are reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sieveline.llm import anchors

WINDOW = 35


class WaveletMatrix:
    """Rank queries on a sequence of small numbers, one packed bit row for each binary digit."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels, n = [], len(values)
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            zeros = n - int(ones.sum())
            self.levels.append((bit, packed, counts, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])
        starts = np.flatnonzero(np.diff(values, prepend=-1))
        self.first = np.zeros(top + 1, np.int64)
        self.first[values[starts]] = starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position at."""
        for bit, packed, counts, zeros in self.levels:
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[word] & below)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at - self.first[symbol]


def prefix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes ordered by their first depth symbols at least, and for 1, 2, 4, ... symbols the class of each prefix."""
    classes, h, n = [text.astype(np.int64)], 1, len(text)
    while True:
        now = classes[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = now[h:] + 1
        keys = now * (int(now.max()) + 2) + after
        order = np.argsort(keys, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[0]]) != 0)
        h *= 2
        if h >= depth:
            return order, classes
        classes.append(new)


def common_prefixes(order: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """Of each suffix with the one before it, how many symbols agree, as far as the classes tell; -1 at both ends."""
    n = len(order)
    a, b, length = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for power in range(len(classes) - 1, -1, -1):
        for _ in range(2 if power == len(classes) - 1 else 1):
            inside = np.maximum(a, b) < n
            same = np.zeros(n - 1, bool)
            same[inside] = classes[power][a[inside]] == classes[power][b[inside]]
            step = same << power
            a, b, length = a + step, b + step, length + step
    return np.concatenate([[-1], length, [-1]])


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the nearest one before, and after, with a smaller value; the ends stand for themselves."""
    n = len(values)
    out = []
    for step, end in ((-1, 0), (1, n - 1)):
        to = np.clip(np.arange(n) + step, 0, n - 1)
        open_ = np.flatnonzero((values[to] >= values) & (to != end))
        while len(open_):
            to[open_] = to[to[open_]]
            open_ = open_[(values[to[open_]] >= values[open_]) & (to[open_] != end)]
        out.append(to)
    return out[0], out[1]


def repeated_spans(pieces: list[np.ndarray], copies: np.ndarray, places: np.ndarray, window: int, top: int) -> list[np.ndarray]:
    """Of each piece (numbers from 1 to top) the spans covered by windows that occur twice in all pieces and their copies."""
    separator = np.zeros(1, np.int32)
    text = np.concatenate([x for p, c in zip(pieces, copies) for x in ([p, separator] * (2 if c > 1 else 1))])
    longest, n = max(map(len, pieces)), len(text)
    order, classes = prefix_order(text, longest + 1)
    lcp = common_prefixes(order, classes)
    before, after = nearest_smaller(lcp)
    index = WaveletMatrix(text[order - 1], top)
    smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])

    streamed = np.flatnonzero(copies <= 1)
    words = np.concatenate([pieces[i] for i in streamed]) if len(streamed) else np.zeros(0, np.int32)
    cuts = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in streamed], dtype=np.int64)])
    matched = np.zeros(len(words), np.int64)
    at = cuts[1:] - 1
    low, high, length = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64), np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        symbol = words[at[live]].astype(np.int64)
        ends = index.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
        lo, hi = smaller[symbol] + ends[: len(live)], smaller[symbol] + ends[len(live) :]
        good = hi - lo > 1
        took = live[good]
        low[took], high[took] = lo[good], hi[good]
        length[took] += 1
        matched[at[took]] = length[took]
        short = live[~good]
        done = short[length[short] == 0]
        cut = short[length[short] > 0]
        left, right = lcp[low[cut]], lcp[high[cut]]
        level = np.maximum(np.maximum(left, right), 0)
        low[cut] = np.where(level == 0, 0, np.where(left == level, before[low[cut]], low[cut]))
        high[cut] = np.where(level == 0, n, np.where(right == level, after[high[cut]], high[cut]))
        length[cut] = level
        moved = np.concatenate([took, done])
        at[moved] -= 1
        live = live[at[live] >= cuts[:-1][live]]
    spans = [np.array([[0, len(p)]]) if c > 1 else np.zeros((0, 2), np.int64) for p, c in zip(pieces, copies)]
    hits = np.flatnonzero(matched >= window)
    of = np.searchsorted(cuts, hits, "right") - 1
    for i in np.unique(of):
        mine = hits[np.searchsorted(of, i) : np.searchsorted(of, i, "right")] - cuts[i]
        spans[streamed[i]] = anchors.covered_spans(mine, mine + matched[mine + cuts[i]])
    return spans


def dedup_substrings(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """Rows of docs without words that lie in a repeated window of words; see :func:`anchors.without_repeats` for the columns and
    for nulls, short and empty texts, repeated rows and empty tables."""
    return anchors.without_repeats(docs, repeated_spans, window, **sizes)
