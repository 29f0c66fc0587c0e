"""Token counts with a whole-token shortcut: the vocabulary is encoded once against itself, which proves the strings that are one
token alone; pre-tokens among them count one, and only the rest is merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.bpe import Vocabulary
from sieveline.llm.encoding import encoder, vocabulary_file
from sieveline.llm.pretokens import text_chunks
from sieveline.llm.tables import documents_of


def whole_or_merged(vocabulary: Vocabulary):
    """Encodes words: those proven to be one token without a merge."""
    whole = vocabulary.whole_tokens()

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        single = np.array([whole.get(w, -1) for w in words], np.int32)
        rest = np.flatnonzero(single < 0)
        merged, sizes = vocabulary.merge([words[i] for i in rest])
        counts = np.ones(len(words), np.int64)
        counts[rest] = sizes
        at = np.repeat(single < 0, counts)
        tokens = np.empty(len(at), np.int32)
        tokens[at], tokens[~at] = merged, single[single >= 0]
        return tokens, counts

    return encode


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text; other columns are ignored).

    The counts are those of the tokenizers library for a byte-level file, without added special tokens; special strings in a text
    count as the token they are. A null or empty text has 0 bytes and tokens. Rows with equal doc_id, null included, are rows of
    their own; an empty table gives no rows. No text is cut."""
    raw = vocabulary_file(docs.sparkSession, tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(raw.value, True, whole_or_merged)
        for batch in batches:
            texts = batch.column("text")
            counts = [own.counts(group) for _, group in text_chunks(texts)]
            sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    docs = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
