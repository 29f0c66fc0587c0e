"""BPE encoding and decoding by guess and check: the longest vocabulary string at each place is guessed, every adjacent pair of
guesses is tested, and only words with a pair that merging would have joined otherwise are merged exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.bpe import KeyTable, Vocabulary
from sieveline.llm.encoding import encoder, vocabulary_file
from sieveline.llm.pretokens import text_chunks
from sieveline.llm.tables import documents_of

_FAR = np.int64(2**31)


class _Longest:
    """A prefix tree of the strings that encode alone as one token, as tables that many words step through together."""

    def __init__(self, whole: dict[bytes, int]):
        nodes, accepts = {}, [-1]
        for text, token in whole.items():
            node = 0
            for byte in text:
                key = node * 256 + byte
                if key not in nodes:
                    nodes[key] = len(accepts)
                    accepts.append(-1)
                node = nodes[key]
            accepts[node] = token
        self.steps = KeyTable(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)), -1)
        self.accepts = np.array(accepts, np.int32)

    def cut(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat at which a guess starts, in order, and its token. begin, end: of the words."""
        places, tokens = [], []
        at, end = begin.copy(), end.copy()
        while len(at):
            node, look, token, reach = np.zeros(len(at), np.int64), at.copy(), np.full(len(at), -1, np.int32), at.copy()
            live = np.arange(len(at))
            while len(live):
                node[live] = self.steps.get(node[live] * 256 + flat[look[live]])
                live = live[node[live] >= 0]
                look[live] += 1
                hit = live[self.accepts[node[live]] >= 0]
                token[hit], reach[hit] = self.accepts[node[hit]], look[hit]
                live = live[look[live] < end[live]]
            places.append(at), tokens.append(token)
            more = reach < end
            at, end = reach[more], end[more]
        place = np.concatenate(places) if places else begin
        order = np.argsort(place, kind="stable")
        return place[order], np.concatenate(tokens)[order] if tokens else np.zeros(0, np.int32)


def joined_otherwise(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the bytes of a and b together gives anything but a and b.

    Merges go by growing rank, so at each rank one part of a ends at the seam and one part of b begins there: going back in time
    from a and b, the one made last is split. The seam is crossed if a pair met there has a lower rank than the merge that took
    its left part away, and no higher one than that of its right part (of equal ranks the left pair goes first)."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    x_until, y_until = np.full(len(x), _FAR), np.full(len(x), _FAR)
    crossed, live = np.zeros(len(x), bool), np.arange(len(x))
    while len(live):
        rank = v.ranks(x[live], y[live])
        hit = (rank < x_until[live]) & (rank <= y_until[live]) & (rank != 2**31 - 1)
        crossed[live[hit]] = True
        live = live[~hit]
        x_made, y_made = v.made_at[x[live]], v.made_at[y[live]]
        live, x_made, y_made = (z[(x_made >= 0) | (y_made >= 0)] for z in (live, x_made, y_made))
        later = y_made >= x_made
        split = live[later]
        y_until[split], y[split] = y_made[later], v.left[y[split]]
        split = live[~later]
        x_until[split], x[split] = x_made[~later], v.right[x[split]]
    return crossed


def guessed_or_merged(v: Vocabulary):
    """Encodes words by guess and check."""
    tree = _Longest(v.whole_tokens())

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(words), np.uint8)
        cuts = np.cumsum([0, *map(len, words)])
        place, tokens = tree.cut(flat, cuts[:-1], cuts[1:])
        word = np.searchsorted(cuts, place, "right") - 1
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, at = np.unique(tokens[inner].astype(np.int64) * v.size + tokens[inner + 1], return_inverse=True)
        wrong = np.zeros(len(words), bool)
        wrong[word[inner[joined_otherwise(v, pairs // v.size, pairs % v.size)[at]]]] = True
        counts = np.bincount(word, minlength=len(words))
        redo = np.flatnonzero(wrong)
        merged, sizes = v.merge([words[i] for i in redo])
        final = counts.copy()
        final[redo] = sizes
        of_redo = np.repeat(wrong, final)
        out = np.empty(len(of_redo), np.int32)
        out[of_redo], out[~of_redo] = merged, tokens[~wrong[word]]
        return out, final

    return encode


class _Bytes:
    """The bytes of all tokens in one array."""

    def __init__(self, v: Vocabulary):
        self.flat = np.frombuffer(b"".join(v.bytes), np.uint8)
        self.cuts = np.cumsum([0, *map(len, v.bytes)])

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.cuts[ids + 1] - self.cuts[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.cuts[ids] - ends[:-1], sizes) + np.arange(ends[-1])], ends


@lru_cache(maxsize=4)
def _bytes_of(v: Vocabulary) -> _Bytes:
    return _Bytes(v)


def _decoded(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    flat, ends = _bytes_of(v).of(ids)
    raw = flat.tobytes()
    return [raw[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", decode_too: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of docs (doc_id, text; other columns are ignored); ids are little-endian unsigned
    32-bit numbers in a binary column. decode_too adds decoded, the text that the ids give.

    The ids are those of the tokenizers library for a byte-level file, without added special tokens; special strings in a text
    become their token. A null or empty text has no ids. Rows with equal doc_id, null included, are rows of their own; an empty
    table gives no rows. No text is cut."""
    raw = vocabulary_file(docs.sparkSession, tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(raw.value, True, guessed_or_merged)
        for batch in batches:
            for first, group in text_chunks(batch.column("text")):
                ids, bounds = own.ids(group)
                out = [
                    batch.column("doc_id").slice(first, len(group)), pa.array(np.diff(bounds), pa.int64()),
                    pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                ]
                out += [pa.array(_decoded(own.vocabulary, ids, bounds), pa.string())] * decode_too
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "decoded"][: len(out)])

    docs = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(rows, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode_too)


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) as :func:`encode` gives them: special tokens are kept, bytes that are no UTF-8 become
    U+FFFD. Null ids count as none."""
    raw = vocabulary_file(encoded.sparkSession, tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(raw.value, True, guessed_or_merged)
        for batch in batches:
            parts = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column("ids").to_pylist()]
            bounds = np.cumsum([0, *map(len, parts)])
            texts = _decoded(own.vocabulary, np.concatenate([*parts, np.zeros(0, np.int64)]), bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return documents_of(encoded, "doc_id", "ids").mapInArrow(rows, "doc_id long, text string")
