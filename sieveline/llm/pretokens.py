"""Pre-tokens of texts, as the tokenizer files ask for them, found by character classes on whole chunks of text.

``spaced``: the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ on the text as it is.
``lower``: 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+ on the text in NFC and lower case, with the rest left out.
Strings of special tokens are cut out of the raw text first; each is a pre-token of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from sieveline.llm.words import BYTE_BASE, give_back, mix, slice_hashes

CHUNK_CHARS, SLICE_ROWS = 1 << 19, 256
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


class Pretokens(NamedTuple):
    """Pre-tokens of some texts: text[start:end] each, its hash, where each text's begin, which are special tokens, and the texts
    with characters newer than Python's character data, whose class and case the tokenizer's own library knows better."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    special_at: dict[int, int]
    unsure: list[int]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, hash code and whether Python's character data knows it, of each code point."""
    classes, known = np.full(0x110000, _OTHER, np.uint8), np.zeros(0x110000, bool)
    for c in (*range(0x33480), *range(0xE0000, 0xE0200)):
        kind = unicodedata.category(chr(c))
        known[c] = kind != "Cn"
        if kind[0] in "LNZ":
            classes[c] = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}[kind[0]]
    classes[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    return classes, mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), known


def _lowered(text: str) -> str:
    text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def _starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray, spaced: bool) -> np.ndarray:
    """Whether a pre-token, or a stretch of white space that is left out, starts at each character. first: where a text starts."""
    n = len(points)
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    if spaced:
        joined = np.zeros(n, bool)
        joined[1:] = (points[:-1] == 32) & (kinds[1:] != _SPACE) & ~first[1:]
        start &= ~joined
        start[:-1] |= (kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~first[1:]
    else:
        start |= kinds == _NUMBER
    quotes = np.flatnonzero((points == 39) & start)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~first[quotes + 1]]
    one = points[quotes + 1]
    two = np.where(quotes + 2 < n, points[np.minimum(quotes + 2, n - 1)], 0)
    two[(quotes + 2 < n) & first[np.minimum(quotes + 2, n - 1)]] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[quotes[short | long] + 1] = False
    then = np.concatenate([quotes[short] + 2, quotes[long] + 3])
    start[then[then < n]] = True
    return start


def pretokens(texts: list[str], spaced: bool, specials: dict[str, int]) -> Pretokens:
    pieces, owners, special_pieces = [], [], {}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
    for i, text in enumerate(texts):
        for j, piece in enumerate(cut.split(text) if any(s in text for s in specials) else [text]):
            if piece:
                if j % 2:
                    special_pieces[len(pieces)] = specials[piece]
                pieces.append(piece if j % 2 or spaced else _lowered(piece))
                owners.append(i)
    text = "".join(pieces)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes, codes, known = _tables()
    kinds = classes[points]
    begin = np.cumsum([0, *map(len, pieces)])
    strange = np.flatnonzero(~known[points]) if not text.isascii() else np.zeros(0, np.int64)
    unsure = sorted({owners[i] for i in np.searchsorted(begin, strange, "right") - 1})
    first = np.zeros(len(points) + 1, bool)
    first[begin[:-1]] = True
    start = _starts(points, kinds, first[:-1], spaced) if len(points) else np.zeros(0, bool)
    for p in special_pieces:
        start[begin[p] : begin[p + 1]] = False
        start[begin[p]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(points))[: len(starts)]
    hashes = slice_hashes(codes[points], BYTE_BASE, starts, ends)
    special_at = {}
    for p, token in special_pieces.items():
        at = int(np.searchsorted(starts, begin[p]))
        hashes[at] = np.uint64(token)
        special_at[at] = token
    if not spaced:
        keep = kinds[starts] != _SPACE
        moved = np.cumsum(keep) - 1
        special_at = {int(moved[a]): t for a, t in special_at.items()}
        starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
    owner = np.array(owners, np.int64)[np.searchsorted(begin, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    return Pretokens(text, starts, ends, hashes, np.searchsorted(owner, np.arange(len(texts) + 1)), special_at, unsure)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of groups of rows with some CHUNK_CHARS together; null counts as empty, and no text is cut. Strings are
    made for a few rows at a time."""
    group, first, held = [], 0, 0
    for row in range(0, len(column), SLICE_ROWS):
        for i, text in enumerate(column.slice(row, SLICE_ROWS).to_pylist(), row):
            group.append(text or "")
            held += len(group[-1])
            if held >= CHUNK_CHARS:
                yield first, group
                group, first, held = [], i + 1, 0
    if group:
        yield first, group
    give_back()
