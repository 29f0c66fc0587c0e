"""Encoding of whole text columns with a tokenizer file, for the operators on tokens."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from sieveline.llm.bpe import Vocabulary, WordStore, vocabulary
from sieveline.llm.pretokens import pretokens

MOST_BYTES = 64 << 20


def vocabulary_file(spark: SparkSession, name: str) -> Broadcast:
    """The bytes of a tokenizer file for all tasks. name: of a public tokenizer, or a path. The size is checked."""
    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{name}: a tokenizer file of more than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


@lru_cache(maxsize=4)
def _library(raw: bytes) -> Tokenizer:
    return Tokenizer.from_str(raw.decode())


class Encoder:
    """Token ids of chunks of texts. encode_words: what turns words into tokens, by default the exact merges."""

    def __init__(self, raw: bytes, spaced: bool, encode_words=None):
        self.raw, self.spaced, self.vocabulary = raw, spaced, vocabulary(raw)
        self.store = WordStore(encode_words(self.vocabulary) if encode_words else self.vocabulary.merge)

    def counts(self, texts: list[str]) -> np.ndarray:
        pre, slots = self._slots(texts)
        sums = np.concatenate([[0], np.cumsum(self.store.counts[slots])])
        out = np.diff(sums[pre.bounds])
        for i in pre.unsure:
            out[i] = len(self._by_library(texts[i]))
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's begin."""
        pre, slots = self._slots(texts)
        ids = self.store.tokens_of(slots)
        bounds = np.concatenate([[0], np.cumsum(self.store.counts[slots])])[pre.bounds]
        if pre.unsure:
            parts = np.split(ids, bounds[1:-1])
            for i in pre.unsure:
                parts[i] = np.array(self._by_library(texts[i]), np.int32)
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds

    def _slots(self, texts: list[str]):
        pre = pretokens(texts, self.spaced, self.vocabulary.specials)
        return pre, self.store.look_up(pre)

    def _by_library(self, text: str) -> list[int]:
        return _library(self.raw).encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def encoder(raw: bytes, spaced: bool, encode_words=None) -> Encoder:
    """One encoder for all chunks and tasks of a Python worker."""
    return Encoder(raw, spaced, encode_words)


__all__ = ["Encoder", "Vocabulary", "encoder", "vocabulary_file"]
