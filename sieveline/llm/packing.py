"""Hierarchical packing of token sequences into windows of several lengths.

Full windows of a document's tokens stand alone. What is left of it goes to the tier of the smallest window that holds it. The
longest tiers are packed first; the gap in a window is filled with the largest pieces of shorter tiers that fit, and at last by
cutting one, so windows are full. Each task packs its own rows block by block and hands what does not fill a window on to its next
block; at its end the rest goes into windows of smaller powers of two. Nothing is shuffled, and a task that is run again gives the
same pieces. Windows of a tier are dealt to step groups so that all have about the same number of tokens and attention cost.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.encoding import encoder, vocabulary_file
from sieveline.llm.pretokens import text_chunks
from sieveline.llm.tables import documents_of

TIERS = (2048, 1024, 512, 256)
END, BLOCK_TOKENS, STEP_TOKENS = 1, 1 << 21, 64 * 2048


class Piece(NamedTuple):
    """length ids of document number doc (in the task), from start on."""

    length: int
    doc: int
    start: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(at, self.doc, self.start), Piece(self.length - at, self.doc, self.start + at)


def fill_windows(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (tier, pieces), all full, and what is left over, which is shorter than a window of the longest tier. No piece is
    longer than that."""
    pool, windows = sorted(pieces), []
    while pool:
        window = [pool.pop()]
        tier = min(t for t in tiers if t >= window[0].length)
        gap = tier - window[0].length
        while gap and pool:
            fits = bisect_right(pool, (gap, 1 << 62, 0))
            if fits:
                taken = pool.pop(fits - 1)
            else:
                shorter = bisect_right(pool, (tier // 2, 1 << 62, 0))
                taken, rest = pool.pop(shorter - 1 if shorter else len(pool) - 1).cut(gap)
                insort(pool, rest)
            window.append(taken)
            gap -= taken.length
        if gap:
            return windows, window
        windows.append((tier, window))
    return windows, []


def last_windows(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Windows of falling powers of two that hold the pieces without padding."""
    left, windows = sum(p.length for p in pieces), []
    pieces = pieces[::-1]
    while left:
        tier = room = 1 << (left.bit_length() - 1)
        window = []
        while room:
            piece = pieces.pop()
            if piece.length > room:
                piece, rest = piece.cut(room)
                pieces.append(rest)
            window.append(piece)
            room -= piece.length
        windows.append((tier, window))
        left -= tier
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A group number for each window: windows of one tier, about step_tokens each, dealt back and forth by attention cost."""
    groups, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        mine = [i for i, (t, _) in enumerate(windows) if t == tier]
        mine.sort(key=lambda i: -sum(p.length**2 for p in windows[i][1]))
        n = max(1, round(len(mine) * tier / step_tokens))
        for k, i in enumerate(mine):
            groups[i] = first + (k % n if k // n % 2 == 0 else n - 1 - k % n)
        first += n
    return groups


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", tiers: tuple[int, ...] = TIERS, end: int = END, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text; other columns are ignored): doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, tier (the window's length, which its pieces fill), step_group.

    A row's tokens are the library's ids and the id `end` after them; each lies in one piece. A null or empty text is the end id
    alone. Rows with equal doc_id, null included, are packed as rows of their own; an empty table gives no rows. tiers are powers
    of two, the longest first. Sequence and group numbers are unique; they hold the number of the task that made them."""
    raw, longest = vocabulary_file(docs.sparkSession, tokenizer), max(tiers)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = encoder(raw.value, False), TaskContext.get().partitionId() << 32
        held: dict[int, tuple[object, np.ndarray]] = {}
        ready: list[tuple[int, list[Piece]]] = []
        rest: list[Piece] = []
        number = tokens = sequences = groups = 0

        def flush(windows):
            nonlocal sequences, groups
            of = step_groups(windows, step_tokens)
            out = []
            for (tier, pieces), group in zip(windows, of):
                offset = 0
                for p in pieces:
                    doc_id, ids = held[p.doc]
                    out.append((doc_id, p.start, p.length, ids[p.start : p.start + p.length].tobytes(), len(ids), base + sequences, offset, tier, base + groups + group))
                    offset += p.length
                sequences += 1
            groups += max(of, default=-1) + 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 4096]), types)], names=names)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, group in text_chunks(batch.column("text")):
                ids, bounds = own.ids(group)
                for i in range(len(group)):
                    mine = np.append(ids[bounds[i] : bounds[i + 1]], end).astype("<u4")
                    held[number] = (doc_ids[first + i], mine)
                    full = len(mine) // longest * longest
                    ready += [(longest, [Piece(longest, number, s)]) for s in range(0, full, longest)]
                    if full < len(mine):
                        rest.append(Piece(len(mine) - full, number, full))
                    number += 1
                    tokens += len(mine)
                if tokens >= block_tokens:
                    windows, rest = fill_windows(rest, tiers)
                    yield from flush(ready + windows)
                    held = {p.doc: held[p.doc] for p in rest}
                    ready, tokens = [], 0
        windows, rest = fill_windows(rest, tiers)
        yield from flush(ready + windows + last_windows(rest))

    docs = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return docs.mapInArrow(rows, schema)
