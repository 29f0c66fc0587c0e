"""Suffix-array dedup with sparse suffix arrays: only suffixes at content-selected minimiser positions are kept.

A shard sorts the contexts that follow its anchors and, read backwards, those before them. Neighbours in each order are compared
for the length on which they agree, which numbers all contexts of any length; a match reaches left and right of its anchor as far
as both numbers agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sieveline.llm import anchors

WINDOW = 50


def _sorted_agreement(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and on how many columns each agrees with the one before (-1 for the first). 0 ends a row."""
    order = np.lexsort(contexts.T[::-1]) if contexts.shape[1] else np.arange(len(contexts))
    rows = contexts[order]
    differ = np.ones((len(rows), contexts.shape[1] + 1), bool)
    differ[1:, :-1] = rows[1:] != rows[:-1]
    agree = differ.argmax(1)
    agree[0] = -1
    return order, agree


def _classes(order: np.ndarray, agree: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(agree < length)
    return out


def repeated_spans(pieces: list[np.ndarray], copies: np.ndarray, places: np.ndarray, window: int, top: int) -> list[np.ndarray]:
    """Of each piece the spans covered by windows, its anchor inside, that occur twice in all pieces and their copies."""
    sizes, places = np.array([len(p) for p in pieces]), places.astype(np.int64)
    right, left = np.zeros((len(pieces), int((sizes - places).max())), np.int32), np.zeros((len(pieces), int(places.max())), np.int32)
    for i, (p, a) in enumerate(zip(pieces, places)):
        right[i, : len(p) - a], left[i, :a] = p[a:], p[:a][::-1]
    by_right, by_left = _sorted_agreement(right), _sorted_agreement(left)
    owners, starts = [], []
    for reach in range(min(left.shape[1], window) + 1):
        rows = np.flatnonzero((places >= reach) & (sizes - places >= window - reach))
        if not len(rows):
            continue
        keys = _classes(*by_left, reach)[rows] * (len(pieces) + 1) + _classes(*by_right, window - reach)[rows]
        _, at = np.unique(keys, return_inverse=True)
        twice = rows[np.bincount(at, weights=np.minimum(copies[rows], 2))[at] > 1]
        owners.append(twice), starts.append(places[twice] - reach)
    owner, start = np.concatenate(owners), np.concatenate(starts)
    order = np.argsort(owner, kind="stable")
    owner, start = owner[order], start[order]
    cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [anchors.covered_spans(start[a:b], start[a:b] + window) for a, b in zip(cuts[:-1], cuts[1:])]


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """Rows of docs without words that lie in a passage of window words or more which occurs twice; see
    :func:`anchors.without_repeats` for the columns and for nulls, short and empty texts, repeated rows and empty tables."""
    return anchors.without_repeats(docs, repeated_spans, window, **sizes)
