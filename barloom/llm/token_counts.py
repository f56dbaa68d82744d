"""Token counts from pre-token frequencies.

The pieces of a distinct pre-token are counted once per task. Per-document pre-token frequencies, in
codes of the distinct pre-tokens, are joined to those counts and summed per document; no list of ids
is made for any document. Everything happens where the documents lie: exchanging (document,
pre-token, frequency) rows for a join across the cluster would move more bytes than the texts have.

Defined cases: a null text is the empty text, with no tokens; special strings inside texts count one
token each; rows repeated are counted each for itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import text_of
from barloom.llm.bpe import CHUNK_BYTES, REMEMBERED, Encoder, texts_of, vocabulary_file


class PieceCounts:
    """Codes of distinct pre-tokens and the number of pieces of each."""

    def __init__(self, content: str):
        self.encoder = Encoder(content)
        self.codes: dict[str, int] = {}
        self.pieces = np.zeros(0, dtype=np.int64)

    def learn(self, words: set[str]) -> None:
        """Counts the pieces of words that have no code yet; of too many the older half goes."""
        if (n := len(self.codes)) > REMEMBERED:
            self.codes = {w: i for i, w in enumerate(islice(self.codes, n // 2, None))}
            self.pieces = self.pieces[n // 2 :]
        new = [w for w in words if w not in self.codes]
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
        counted = np.array(list(map(len, self.encoder.tokens_of(new))), dtype=np.int64)
        self.pieces = np.append(self.pieces, counted)


def frequencies(documents: list[list[str]], codes: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(document, code, how often) of each pre-token of each document."""
    sizes = list(map(len, documents))
    flat = [code for words in documents for code in map(codes.__getitem__, words)]
    owner = np.repeat(np.arange(len(documents), dtype=np.int64), sizes)
    keys, often = np.unique((owner << 32) | np.array(flat, dtype=np.int64), return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, often


def token_counts(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))
    said = docs.select(
        F.col(f"`{key}`").alias("id"), text_of(F.col(f"`{text}`")).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(content.value)
        for batch in batches:
            for start, texts in texts_of(batch.column("text"), CHUNK_BYTES):
                words = [counts.encoder.words(t) for t in texts]
                counts.learn({w for ws in words for w in ws})
                document, code, often = frequencies(words, counts.codes)
                tokens = np.zeros(len(texts), dtype=np.int64)
                np.add.at(tokens, document, often * counts.pieces[code])
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, len(texts)),
                        pa.array(size, pa.int64()),
                        pa.array(tokens, pa.int64()),
                    ],
                    names=["id", "n_bytes", "n_tokens"],
                )

    schema = said.select("id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return said.mapInArrow(count, schema).select(
        F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
