"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, of the words' stems (their first bytes), of pairs
of neighbouring words and of pairs with one word between, hashed into DIMENSIONS places. Training
goes through a bounded sample of labelled rows; every coordinate has its own learning rate, and the
L1 term leaves most weights at zero, so the model is a short list of places and weights, which is
broadcast. Scoring is a map over the documents.

Defined cases: a null text is the empty text and scores by the bias alone; of several rows of one id
training sees the one with the smallest text, of several labels the greatest; labels that are null,
and labels without a document, are ignored; without any labels nothing is known to be toxic and every
score is about 0; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.base import text_of
from barloom.llm.hashing import WordHasher, buffers, chunks, mixed

DIMENSIONS = 1 << 22
#: Bytes that make a word's stem.
HEADS = (4, 5, 6)
_WORD_BYTES = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ORDER = [("id", "ascending"), ("label", "ascending"), ("size", "ascending")]
#: Bias of a model without any labels.
_UNKNOWN = -35.0
_SEPARATORS = bytes(b for b in range(128) if b not in _WORD_BYTES)


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the labelled documents that training sees, ``most`` their features.

    Both take documents in the order of a hash of their ids.
    """

    sample: int = 16_000
    most: int = 64_000_000
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.05
    rarest: int = 3


def features(
    hasher: WordHasher, data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature occurrence."""
    _, _, hashes, first, *stems = hasher.words(data, offsets, HEADS)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kinds = [(text, hashes), *[(text, stem) for stem in stems]]
    for apart in (1, 2):
        same = text[apart:] == text[:-apart]
        with np.errstate(over="ignore"):
            pair = hashes[:-apart] * np.uint64(0x9E3779B97F4A7C15) + hashes[apart:]
        kinds.append((text[apart:][same], pair[same]))
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    # stems share a salt, as a short word is its own stem
    salts = [1, 2, 2, 2, 3, 4]
    places = [
        (mixed(h ^ mixed(np.uint64([salt]))) >> shift).astype(np.int32)
        for salt, (_, h) in zip(salts, kinds, strict=True)
    ]
    return np.concatenate([t for t, _ in kinds]), np.concatenate(places)


def _hasher() -> WordHasher:
    return WordHasher(_SEPARATORS, lower=True)


def fit(rows: list[np.ndarray], labels: np.ndarray, training: Training) -> tuple:
    """(places, weights, bias) from the distinct features of each row."""
    seen = np.zeros(DIMENSIONS, dtype=np.int32)
    for row in rows:
        seen[row] += 1
    rows = [np.append(row[seen[row] >= training.rarest], DIMENSIONS) for row in rows]
    del seen
    z = np.zeros(DIMENSIONS + 1)
    n = np.zeros(DIMENSIONS + 1)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        over = np.maximum(np.abs(zs) - training.l1, 0.0)
        return -np.sign(zs) * over / ((training.beta + np.sqrt(ns)) / training.alpha + training.l2)

    order = np.random.default_rng(11)
    for _ in range(training.epochs):
        for i in order.permutation(len(rows)):
            row = rows[i]
            zs, ns = z[row], n[row]
            w = weights(zs, ns)
            gradient = 1.0 / (1.0 + np.exp(-w.sum().clip(-35, 35))) - labels[i]
            square = gradient * gradient
            z[row] = zs + gradient - (np.sqrt(ns + square) - np.sqrt(ns)) / training.alpha * w
            n[row] = ns + square
    touched = np.flatnonzero(n[:-1])
    w = weights(z[touched], n[touched])
    bias = weights(z[-1:], n[-1:])[0]
    return touched[w != 0].astype(np.int32), w[w != 0], float(bias)


def sampled_labels(
    labels: DataFrame, sample: int, key: str = "doc_id", label: str = "toxic"
) -> DataFrame:
    """At most ``sample`` ids with their label that training may see, by a hash of the id."""
    known = labels.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("double").alias("label")
    ).where("label IS NOT NULL AND id IS NOT NULL")
    known = known.where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(sample)


def held_out(id_: Column) -> Column:
    """Ids whose labels training never sees."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    training: Training = Training(),
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """(place, weight): the model, the bias at place DIMENSIONS.

    Features are made where the documents lie; the bounded sample of feature
    rows is gone through by one task.
    """
    # bounded by ``training.sample``
    chosen = F.broadcast(sampled_labels(labels, training.sample, key, label))
    rows = docs.select(
        F.col(f"`{key}`").alias("id"), text_of(F.col(f"`{text}`")).alias("text")
    ).join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                texts, places = features(hasher, data, offsets[i : j + 1])
                keys = np.unique((texts << 32) | places)
                limits = np.searchsorted(keys >> 32, np.arange(j - i + 1))
                places = (keys & 0xFFFFFFFF).astype(np.int32)
                blobs = [places[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(i, j - i),
                        batch.column("label").slice(i, j - i),
                        pa.array(np.diff(limits), pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["id", "label", "size", "places"],
                )

    def learn(table: pa.Table) -> pa.Table:
        # the order must not depend on how the rows arrive
        order = pc.sort_indices(table.select(["id", "label", "size"]), _ORDER).to_numpy()
        rows = []
        for batch in table.to_batches():
            data, offsets = buffers(batch.column("places"))
            rows += [data[a:b].view(np.int32) for a, b in zip(offsets[:-1], offsets[1:])]
        labels = table.column("label").to_numpy()[order]
        places, weights, bias = fit([rows[i] for i in order], labels, training)
        return pa.table(
            {
                "place": pa.array(np.append(places, DIMENSIONS), pa.int32()),
                "weight": pa.array(np.append(weights, bias), pa.float64()),
            }
        )

    schema = rows.select("id", "label").schema.add("size", "long").add("places", "binary")
    so_far = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.select("id", "label", "text")
        .mapInArrow(extract, schema)
        .withColumn("so_far", F.sum("size").over(so_far))
        .where(F.col("so_far") <= training.most)
        .drop("so_far")
        .groupBy(F.lit(0).alias("sample"))
        .applyInArrow(learn, "place int, weight double")
    )


def scored(
    docs: DataFrame, model: DataFrame, text: str = "text", score: str = "score"
) -> DataFrame:
    """The documents, all columns, with their score between 0 and 1."""
    # at most DIMENSIONS + 1 pairs of a place and a weight
    rows = model.limit(DIMENSIONS + 1).collect() or [(DIMENSIONS, _UNKNOWN)]
    places, weights = zip(*rows)
    shipped = docs.sparkSession.sparkContext.broadcast(
        (np.array(places, dtype=np.int32), np.array(weights, dtype=np.float32))
    )
    kept = [c for c in docs.columns if c.lower() != score.lower()]
    columns = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*columns.schema.fields, T.StructField(score, T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        weights = np.zeros(DIMENSIONS + 1, dtype=np.float32)
        weights[shipped.value[0]] = shipped.value[1]
        used = weights != 0
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            scores = np.zeros(len(batch))
            for i, j in chunks(offsets):
                texts, places = features(hasher, data, offsets[i : j + 1])
                hit = used[places]
                keys = np.unique((texts[hit] << 32) | places[hit])
                sums = np.bincount(keys >> 32, weights[keys & 0xFFFFFFFF], minlength=j - i)
                scores[i:j] = 1 / (1 + np.exp(-(sums + weights[DIMENSIONS]).clip(-35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(scores)], names=[*kept, score]
            )

    return columns.mapInArrow(rate, schema)
