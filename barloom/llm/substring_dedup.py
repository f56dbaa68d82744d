"""Substring deduplication with difference-cover anchors.

Two equal passages of LENGTH words start at any two places. The cover {0, 1, 3} modulo 7 holds a
pair of places for every difference, so some shift below 7 puts both passages on cover positions at
once: hashing the ANCHOR = LENGTH - 6 words at cover positions only (3 of 7) still gives every
shared passage a common, aligned anchor. Windows around anchors that two documents share are then
extended to the full length and compared; nothing else is.

Documents are dealt into chunks by id. A chunk sends each hash once, however many of its documents
hold it, to the bucket of the hash, and hears back which of its hashes others hold too; so a passage
that a third of all documents share costs one entry per chunk. No pairs of documents are made. The
texts are shuffled once; all three passes over them read the same exchange.

Defined cases: a null text has no words; a null id counts as greater than all others; rows repeated
with one id are one document to each other (neither is smaller); a text of fewer words than a window
keeps all; an empty table gives no rows; other columns are ignored. Window equality rests on 64-bit
hashes of the words of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import key_of, partitions, text_of
from barloom.llm.hashing import WordHasher, buffers, chunks, grams

LENGTH = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = LENGTH - PERIOD + 1
#: Chunks of documents per shuffle partition.
CHUNKS_PER_PARTITION = 2

_NO_ID = (1 << 63) - 1


class _Piece:
    """Some documents of a chunk: their words as byte ranges and hashes, and whose they are."""

    def __init__(self, hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.data, self.offsets, self.ids = data, offsets, ids
        self.starts, self.ends, self.hashes, self.first = hasher.words(data, offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(ids)), self.n_words)
        self.place = np.arange(len(self.doc)) - np.repeat(self.first[:-1], self.n_words)

    def whole(self, n: int) -> np.ndarray:
        """For each word: do the n words from here lie in one document?"""
        left = np.repeat(self.n_words, self.n_words) - self.place
        return left >= n

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every anchor."""
        on_cover = np.isin(self.place % PERIOD, COVER) & self.whole(ANCHOR)
        at = np.flatnonzero(on_cover)
        return at, grams(self.hashes, ANCHOR)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.whole(LENGTH))
        return at, grams(self.hashes, LENGTH)[at]


def _pieces(docs: pa.Table) -> Iterator[_Piece]:
    hasher = WordHasher()
    for batch in docs.to_batches():
        ids = batch.column("place").to_numpy()
        data, offsets = buffers(batch.column("text"))
        for i, j in chunks(offsets):
            yield _Piece(hasher, data, offsets[i : j + 1], ids[i:j])


def _known(wanted: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Place of each wanted hash in the sorted array, -1 where it isn't."""
    if not len(there):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
    return np.where(there[at] == wanted, at, -1)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(sorted_values), dtype=bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Limits, in a sorted array of hashes, of equal ranges of the hash space."""
    lows = [np.uint64((i << 64) // buckets) for i in range(buckets)]
    return np.append(np.searchsorted(hashes, np.array(lows, dtype=np.uint64)), len(hashes))


def _sent(chunk: int, buckets: int, hashes: np.ndarray, *more: np.ndarray) -> pa.Table:
    limits = _by_bucket(hashes, buckets)
    full = [i for i in range(buckets) if limits[i] < limits[i + 1]]
    columns = [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int32())]
    for values in (hashes, *more):
        blobs = [values[limits[i] : limits[i + 1]].tobytes() for i in full]
        columns.append(pa.array(blobs, pa.binary()))
    names = ["bucket", "chunk", "hashes", "low", "high"][: len(columns)]
    return pa.table(dict(zip(names, columns, strict=True)))


def _read(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]


def _extremes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Distinct hashes, sorted, with the least and the greatest document of each."""
    order = np.argsort(hashes, kind="stable")
    hashes, low, high = hashes[order], low[order], high[order]
    at = _runs(hashes)
    if not len(at):
        return hashes, low, high
    return hashes[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text): the texts without passages that an earlier document has.

    A word goes if it lies in a window of LENGTH words whose word sequence also
    starts in a document with a smaller id. Kept words are joined by one space.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    id_ = F.col(f"`{key}`").cast("long")
    n_chunks = CHUNKS_PER_PARTITION * buckets
    keyed = docs.select(
        F.pmod(F.xxhash64(key_of(id_)), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.coalesce(id_, F.lit(_NO_ID)).alias("place"),
        text_of(F.col(f"`{text}`")).alias("text"),
    )

    def anchors(table: pa.Table) -> pa.Table:
        """Each anchor hash of the chunk once; the lowest bit tells that two documents hold it."""
        hashes, owners = [], []
        for piece in _pieces(table):
            at, found = piece.anchors()
            hashes.append(found)
            owners.append(piece.ids[piece.doc[at]])
        owners = _joined(owners, np.int64)
        distinct, low, high = _extremes(_joined(hashes, np.uint64) >> np.uint64(1), owners, owners)
        coded = (distinct << np.uint64(1)) | (low < high).astype(np.uint64)
        return _sent(table.column("chunk")[0].as_py(), buckets, coded)

    def shared(table: pa.Table) -> pa.Table:
        """For each chunk, those of its anchor hashes that two documents hold, here or elsewhere."""
        parts = _read(table, "hashes", np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        coded = _joined(parts, np.uint64)
        order = np.argsort(coded, kind="stable")
        coded, owner = coded[order], owner[order]
        at = _runs(coded >> np.uint64(1))
        sizes = np.diff(np.append(at, len(coded)))
        several = np.zeros(len(at), dtype=bool)
        if len(at):
            several = (sizes > 1) | (np.bitwise_or.reduceat(coded, at) & np.uint64(1)).astype(bool)
        keep = np.repeat(several, sizes)
        coded, owner = coded[keep] >> np.uint64(1), owner[keep]
        order = np.argsort(owner, kind="stable")
        limits = np.searchsorted(owner[order], np.arange(len(parts) + 1))
        blobs = [coded[order[limits[i] : limits[i + 1]]].tobytes() for i in range(len(parts))]
        return pa.table({"chunk": table.column("chunk"), "hashes": pa.array(blobs, pa.binary())})

    def extended(table: pa.Table, answer: pa.Table) -> pa.Table:
        """Hashes of the full windows around shared anchors, with the documents they lie in."""
        there = np.sort(_joined(_read(answer, "hashes", np.uint64), np.uint64))
        hashes, owners = [], []
        for piece in _pieces(table):
            at, found = piece.anchors()
            hit = at[_known(found >> np.uint64(1), there) >= 0]
            # windows that hold the anchor at one of the first PERIOD places
            step = np.zeros(len(piece.doc) + 1, dtype=np.int64)
            np.add.at(step, np.maximum(hit - (PERIOD - 1), piece.first[piece.doc[hit]]), 1)
            np.add.at(step, hit + 1, -1)
            windows, full = piece.windows()
            near = np.cumsum(step)[windows] > 0
            hashes.append(full[near])
            owners.append(piece.ids[piece.doc[windows[near]]])
        owners = _joined(owners, np.int64)
        found = _extremes(_joined(hashes, np.uint64), owners, owners)
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        return _sent(chunk, buckets, *found)

    def least(table: pa.Table) -> pa.Table:
        """For each chunk, the windows that a smaller document has than one of its own."""
        parts = _read(table, "hashes", np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        hashes = _joined(parts, np.uint64)
        low, high = (_joined(_read(table, c, np.int64), np.int64) for c in ("low", "high"))
        distinct, lowest, _ = _extremes(hashes, low, high)
        lowest = lowest[_known(hashes, distinct)] if len(hashes) else low
        blobs = {"hashes": [], "low": []}
        for i in range(len(parts)):
            mine = (owner == i) & (lowest < high)
            blobs["hashes"].append(hashes[mine].tobytes())
            blobs["low"].append(lowest[mine].tobytes())
        columns = {name: pa.array(x, pa.binary()) for name, x in blobs.items()}
        return pa.table({"chunk": table.column("chunk"), **columns})

    def kept(table: pa.Table, answer: pa.Table) -> pa.Table:
        hashes = _joined(_read(answer, "hashes", np.uint64), np.uint64)
        low = _joined(_read(answer, "low", np.int64), np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, low = hashes[order], low[order]
        tables = []
        for piece in _pieces(table):
            at, found = piece.windows()
            known = _known(found, hashes)
            hit = known >= 0
            at, known = at[hit], known[hit]
            at = at[low[known] < piece.ids[piece.doc[at]]]
            step = np.zeros(len(piece.doc) + 1, dtype=np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + LENGTH, -1)
            stays = np.cumsum(step)[:-1] == 0
            removed = np.bincount(piece.doc[~stays], minlength=len(piece.ids))
            tables.append(
                pa.table(
                    {
                        "place": pa.array(piece.ids, pa.int64()),
                        "n_words": pa.array(piece.n_words, pa.int64()),
                        "n_removed": pa.array(removed, pa.int64()),
                        "text": _rebuilt(piece, stays),
                    }
                )
            )
        return pa.concat_tables(tables) if tables else _NOTHING

    to_bucket = "bucket int, chunk int, hashes binary"
    held = (
        keyed.groupBy("chunk").applyInArrow(anchors, to_bucket)
        .groupBy("bucket").applyInArrow(shared, "chunk int, hashes binary")
    )
    windows = (
        keyed.groupBy("chunk").cogroup(held.groupBy("chunk"))
        .applyInArrow(extended, f"{to_bucket}, low binary, high binary")
        .groupBy("bucket").applyInArrow(least, "chunk int, hashes binary, low binary")
    )
    found = (
        keyed.groupBy("chunk").cogroup(windows.groupBy("chunk"))
        .applyInArrow(kept, "place long, n_words long, n_removed long, text string")
    )
    return found.select(
        F.when(F.col("place") != _NO_ID, F.col("place")).alias(key), "n_words", "n_removed", "text"
    )


_NOTHING = pa.table(
    {
        "place": pa.array([], pa.int64()),
        "n_words": pa.array([], pa.int64()),
        "n_removed": pa.array([], pa.int64()),
        "text": pa.array([], pa.string()),
    }
)


def _rebuilt(piece: _Piece, stays: np.ndarray) -> pa.Array:
    """The staying words of each text, joined by one space."""
    low, high = int(piece.offsets[0]), int(piece.offsets[-1])
    data = piece.data[low:high].copy()
    words = np.flatnonzero(stays)
    starts, ends, doc = piece.starts[words] - low, piece.ends[words] - low, piece.doc[words]
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1  # words never touch, so no place begins one and ends another in one text
    inside = np.cumsum(step, dtype=np.int8)[:-1].astype(bool)
    followed = np.zeros(len(words), dtype=bool)
    followed[:-1] = doc[1:] == doc[:-1]
    inside[ends[followed]] = True
    data[ends[followed]] = 0x20
    total = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(inside, dtype=np.int32)])
    limits = total[piece.offsets - low]
    return pa.Array.from_buffers(
        pa.string(),
        len(piece.ids),
        [None, pa.py_buffer(limits.tobytes()), pa.py_buffer(data[inside].tobytes())],
    )
