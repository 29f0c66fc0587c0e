"""Byte pair encoding on many words at once.

:class:`Vocabulary` is read from a tokenizer file. :meth:`Vocabulary.merge` applies the merges exactly, one lowest-ranked pair of
each word in each round, to all words of a length together. Nothing is trained here.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

_NONE = np.int32(2**31 - 1)
LONG = 48  # words of more bytes are merged one by one through a heap


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class KeyTable:
    """Fixed numbers for 64-bit keys, by open addressing; `missing` for a key that is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int32)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            won = first[free[first]]
            self.keys[slots[won]], self.values[slots[won]] = keys[left[won]], values[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, slots = left[stay], slots[stay]
            slots = np.where(self.keys[slots] != -1, (slots + 1) & self.mask, slots)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        out, at = self.values[slots], self.keys[slots]
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            at = self.keys[slots[open_]]
            out[open_] = self.values[slots[open_]]
            open_ = open_[(at != keys[open_]) & (at != -1)]
        return out


class Vocabulary:
    """Merges of a byte-level vocabulary; a rank is the place of a merge in the file, lower ones go first."""

    def __init__(self, raw: bytes):
        model = (data := json.loads(raw))["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = max(ids.values()) + 1
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        chars = byte_characters()
        self.first = np.array([ids[c] for c in chars], np.int32)
        self.last = np.array([ids[c + suffix] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.full(self.size, -1, np.int32)
        self.right, self.made_at = self.left.copy(), self.left.copy()
        a, b, made = (np.array(x, np.int64) for x in zip(*((ids[x], ids[y], ids[x + y]) for x, y in pairs)))
        rank = np.arange(len(pairs))
        self.left[made], self.right[made], self.made_at[made] = a, b, rank
        self.pair_rank = KeyTable(a * self.size + b, rank, int(_NONE))
        self.made = made.astype(np.int32)
        if len(np.unique(made)) < len(made) or (np.maximum(self.made_at[a], self.made_at[b]) >= rank).any():
            raise ValueError("a token is made by two merges, or by a merge that comes before its parts")
        of = {c: b for b, c in enumerate(chars)}
        self.bytes = [b""] * self.size
        for text, i in ids.items():
            self.bytes[i] = bytes(of[c] for c in text.removesuffix(suffix))
        for text, i in self.specials.items():
            self.bytes += [b""] * (i + 1 - len(self.bytes))
            self.bytes[i] = text.encode()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pair_rank.get(a.astype(np.int64) * self.size + b)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words (none empty) one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        symbols = self.first[flat]
        if len(words):
            symbols[cuts[1:] - 1] = self.last[flat[cuts[1:] - 1]]
        counts = np.ones(len(words), np.int64)
        for size in np.unique(sizes[sizes > 1]):
            rows = np.flatnonzero(sizes == size)
            if size > LONG:
                for i in rows:
                    out = self._merge_long(symbols[cuts[i] : cuts[i + 1]].tolist())
                    counts[i] = len(out)
                    symbols[cuts[i] : cuts[i] + len(out)] = out
                continue
            for part in np.array_split(rows, -(-len(rows) * int(size) // 2_000_000)):
                at = cuts[part][:, None] + np.arange(size)
                grid, counts[part] = self._merge_grid(symbols[at])
                symbols[at] = grid
        stays = np.arange(len(flat)) - np.repeat(cuts[:-1], sizes) < np.repeat(counts, sizes)
        return symbols[stays], counts

    def _merge_grid(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = grid.shape[1]
        ranks = self.ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(len(grid), width - 1)
        counts = np.full(len(grid), width)
        out, live, now = grid.copy(), np.arange(len(grid)), grid.copy()
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            go = best != _NONE
            if not go.all():
                out[live[~go]] = now[~go]
                live, now, ranks, at, best = live[go], now[go], ranks[go], at[go], best[go]
                if not len(live):
                    break
            row = np.arange(len(live))
            columns = np.arange(width - 1)
            now[:, 1:-1] = np.take_along_axis(now, columns[1:] + (columns[1:] > at[:, None]), 1) if width > 2 else now[:, 1:-1]
            now[row, at] = self.made[best]
            ranks[:, :-1] = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), 1)
            ranks[:, -1] = _NONE
            counts[live] -= 1
            size = counts[live]
            back = at > 0
            ranks[row[back], at[back] - 1] = self.ranks(now[row[back], at[back] - 1], now[row[back], at[back]])
            ahead = at + 1 < size
            ranks[row[ahead], at[ahead]] = self.ranks(now[row[ahead], at[ahead]], now[row[ahead], at[ahead] + 1])
        return out, counts

    def _merge_long(self, word: list[int]) -> list[int]:
        after, before, gone = [*range(1, len(word) + 1)], [*range(-1, len(word) - 1)], [False] * len(word)
        word_array = np.array(word)
        heap = [(int(r), i, a, b) for i, (r, a, b) in enumerate(zip(self.ranks(word_array[:-1], word_array[1:]), word, word[1:])) if r != _NONE]
        heapq.heapify(heap)
        rank_of = self._rank_of
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or word[i] != a or j >= len(word) or word[j] != b:
                continue
            word[i], gone[j], after[i] = int(self.made[rank]), True, after[j]
            if after[i] < len(word):
                before[after[i]] = i
                if (r := rank_of(word[i], word[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, word[i], word[after[i]]))
            if (h := before[i]) >= 0 and (r := rank_of(word[h], word[i])) is not None:
                heapq.heappush(heap, (r, h, word[h], word[i]))
        return [t for t, x in zip(word, gone) if not x]

    def _rank_of(self, a: int, b: int) -> int | None:
        r = int(self.ranks(np.array([a]), np.array([b]))[0])
        return None if r == _NONE else r

    def whole_tokens(self) -> dict[bytes, int]:
        """The strings that encode alone as one token, found by encoding every string of the vocabulary."""
        ids = [i for i, b in enumerate(self.bytes) if b and i not in self.specials.values()]
        tokens, counts = self.merge([self.bytes[i] for i in ids])
        single = tokens[np.cumsum(counts) - counts]
        return {self.bytes[i]: i for i, n, t in zip(ids, counts, single) if n == 1 and t == i}


@lru_cache(maxsize=4)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


class WordStore:
    """Tokens of words seen, kept by a task between chunks: at most `most` words, then it starts anew. It saves work only."""

    def __init__(self, encode, most: int = 200_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.tokens, self.offsets, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def put(self, hashes: list[int], tokens: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.slots)
        while len(self.offsets) < first + len(hashes):
            self.offsets, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offsets, self.counts))
        while len(self.tokens) < self.used + len(tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.tokens[self.used : self.used + len(tokens)] = tokens
        self.offsets[first : first + len(hashes)] = self.used + np.cumsum(counts) - counts
        self.counts[first : first + len(hashes)] = counts
        self.slots.update(zip(hashes, range(first, first + len(hashes))))
        self.used += len(tokens)

    def look_up(self, pre) -> np.ndarray:
        """The slot of each pre-token of a chunk; words not seen before are encoded together."""
        hashes, first, at = np.unique(pre.hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(hashes) > self.most:
            self.clear()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.slots]
        if new:
            special = {pre.special_at[f]: i for i in new if (f := int(first[i])) in pre.special_at}
            plain = [i for i in new if int(first[i]) not in pre.special_at]
            words = [pre.text[a:b].encode() for a, b in zip(pre.starts[first[plain]].tolist(), pre.ends[first[plain]].tolist())]
            self.put([keys[i] for i in plain], *self.encode(words))
            self.put([keys[i] for i in special.values()], np.array([*special], np.int32), np.ones(len(special), np.int64))
        return np.array([self.slots[h] for h in keys], np.int64)[at]

    def tokens_of(self, slots: np.ndarray) -> np.ndarray:
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        return self.tokens[np.repeat(self.offsets[slots] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
