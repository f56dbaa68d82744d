"""Ranked lexical search: every item of a query table against all documents.

Terms are runs of ASCII letters and digits and code points beyond ASCII, with A-Z made small. One
scan of the documents keeps what the queries can match, as a table of (document, its number of
terms, its query terms and how often each occurs), with the corpus statistics aggregated from it.
Each task of the second scan inverts a shard of that table into posting lists and answers all queries
on it; the best of all shards are ranked by Spark.

Within a shard a query runs as a hybrid. Its short lists are summed term at a time into accumulators,
which then take part as one more list with a known greatest value. The long lists are read document
at a time, in blocks of documents: lists whose greatest values together cannot reach the current
k-th score only complete the scores of documents that the others bring up, and blocks whose bounds
cannot reach it are skipped. Skipping compares strictly, so that equal scores are still found.

Defined cases: a null text has no terms and doesn't count as a document; an item without terms, or
whose terms no document has, gets no rows; a term that an item repeats counts each time; items of one
id are one query of all their terms; a null id is an id of its own; documents of one id are ranked
each for itself, null ids after all others; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.base import stored, text_of
from barloom.llm.hashing import WordHasher, buffers, chunks

BEST = 20
#: Bytes of query texts answered in one go; more are answered block by block.
BLOCK_BYTES = 8_000_000
#: Documents of a shard, and of a block within it.
SHARD_ROWS, BLOCK_ROWS = 1 << 16, 1 << 10
#: Lists of at most this share of a shard's documents are short.
SHORT = 1 / 32

# Bytes between terms, and the constants of the score.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


class Terms:
    """Distinct query terms by code, found in texts by hash and verified byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.hasher = WordHasher(SEPARATORS, lower=True)
        self.terms = terms
        hashes = self._hashes(terms)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.length = np.array(list(map(len, terms)), dtype=np.int64)
        longest = -(-max([1, *map(len, terms)]) // 8)
        padded = b"".join(t.ljust(longest * 8, b"\0") for t in terms)
        self.eights = np.frombuffer(padded, dtype="<u8").reshape(len(terms), longest)
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two query terms of one hash")

    def _hashes(self, terms: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b" ".join(terms) + b" ", dtype=np.uint8)
        return self.hasher.words(data, np.array([0, len(data)]))[2]

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(terms of each text, text of each match, its code)."""
        starts, ends, hashes, first = self.hasher.words(data, offsets)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if not self.terms:
            return np.diff(first), text[:0], text[:0]
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.terms) - 1)
        code = self.order[at]
        hit = np.flatnonzero((self.sorted[at] == hashes) & (self.length[code] == ends - starts))
        code, starts = code[hit], starts[hit]
        small = _SMALL[np.concatenate([data[: offsets[-1]], np.zeros(8, dtype=np.uint8)])]
        view = np.ndarray(len(small) - 7, dtype="<u8", buffer=small, strides=(1,))
        same = np.ones(len(hit), dtype=bool)
        left = self.length[code]
        for k in range(self.eights.shape[1]):
            on = np.flatnonzero(left > 8 * k)
            used = np.minimum(left[on] - 8 * k, 8).astype(np.uint64)
            mask = np.where(used == 8, ~np.uint64(0), (np.uint64(1) << (used * 8)) - np.uint64(1))
            same[on] &= (view[starts[on] + 8 * k] & mask) == self.eights[code[on], k]
        return np.diff(first), text[hit[same]], code[same]


def _query_terms(text: bytes) -> list[bytes]:
    return text.translate(bytes(32 if b in SEPARATORS else int(_SMALL[b]) for b in range(256))).split()


def _lookup(docs: DataFrame, terms: list[bytes], key: str, text: str) -> DataFrame:
    """(id, n, terms, counts): each document's number of terms and its query terms' frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    said = docs.select(F.col(f"`{key}`").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(sent.value)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                n, owner, code = known.found(data, offsets[i : j + 1])
                keys, often = np.unique(owner * len(known.terms) + code, return_counts=True)
                owner, code = np.divmod(keys, max(len(known.terms), 1))
                limits = pa.array(np.searchsorted(owner, np.arange(j - i + 1)), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(limits, pa.array(x, pa.int32())) for x in (code, often)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(n, pa.int64()), *lists],
                    names=["id", "n", "terms", "counts"],
                )

    schema = said.select("id").schema.add("n", "long")
    for name in ("terms", "counts"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return said.mapInArrow(scan, schema)


class Shard:
    """Posting lists of a shard's documents, each posting with its term's part of the score."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, code: np.ndarray, often: np.ndarray,
                 weights: np.ndarray, documents: int, total: int):
        self.rows = len(n)
        length = 100 - 25 + (25 * n * documents) // max(total, 1)
        order = np.argsort(code, kind="stable")
        self.document = owner[order]
        tf = often[order].astype(np.int64)
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * length[self.document])
        self.part = weights[code[order]] * part
        self.limits = np.searchsorted(code[order], np.arange(len(weights) + 1))

    def postings(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.limits[code], self.limits[code + 1])
        return self.document[span], self.part[span]

    def best(self, codes: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, ties by document; hybrid of both orders."""
        sizes = self.limits[codes + 1] - self.limits[codes]
        short = sizes <= max(self.rows * SHORT, 1)
        lists = [self._summed(codes[short], times[short])]
        for code, often in zip(codes[~short].tolist(), times[~short].tolist(), strict=True):
            document, part = self.postings(code)
            lists.append((document, part * often))
        lists = [x for x in lists if len(x[0])]
        if not lists:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        top = Top(k)
        # a document's score is at least its accumulator: a first bound before any list is read
        seed = lists[0][1]
        floor = int(np.partition(seed, -k)[-k]) if len(seed) >= k else 0
        bounds = np.array([int(part.max()) for _, part in lists])
        order = np.argsort(bounds, kind="stable")
        lists, reach = [lists[i] for i in order], np.cumsum(bounds[order])
        edges = np.arange(0, self.rows + BLOCK_ROWS, BLOCK_ROWS)
        cuts = [np.searchsorted(document, edges) for document, _ in lists]
        for b in range(len(edges) - 1):
            floor = max(floor, top.floor)
            # lists before ``lead`` can't reach the floor together
            lead = int(np.searchsorted(reach, floor, side="left"))
            if lead == len(lists):
                break
            spans = [slice(cut[b], cut[b + 1]) for cut in cuts]
            tops = [
                int(part[s].max()) if s.stop > s.start else 0
                for (_, part), s in zip(lists, spans, strict=True)
            ]
            if sum(tops) < max(floor, 1) or not any(tops[lead:]):
                continue
            document, score = self._merged(lists, spans, lead, edges[b])
            rest = sum(tops[:lead])
            for i in range(lead - 1, -1, -1):
                near = np.flatnonzero(score + rest >= floor)
                document, score = document[near], score[near]
                rest -= tops[i]
                other, part = (x[spans[i]] for x in lists[i])
                if len(other) and len(document):
                    at = np.minimum(np.searchsorted(other, document), len(other) - 1)
                    score = score + np.where(other[at] == document, part[at], 0)
            top.add(document, score)
        return top.found()

    def _summed(self, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The short lists term at a time: documents in order and their accumulators."""
        held = [self.postings(c) for c in codes.tolist()]
        if not held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        document, back = np.unique(np.concatenate([d for d, _ in held]), return_inverse=True)
        sums = np.zeros(len(document), dtype=np.int64)
        np.add.at(sums, back, np.concatenate([p * t for (_, p), t in zip(held, times.tolist())]))
        return document, sums

    @staticmethod
    def _merged(lists: list, spans: list[slice], lead: int, base: int) -> tuple[np.ndarray, ...]:
        """Documents of a block that the leading lists bring up, with their sums."""
        sums = np.zeros(BLOCK_ROWS, dtype=np.int64)
        seen = np.zeros(BLOCK_ROWS, dtype=bool)
        for (document, part), span in zip(lists[lead:], spans[lead:], strict=True):
            at = document[span] - base
            sums[at] += part[span]
            seen[at] = True
        at = np.flatnonzero(seen)
        return at + base, sums[at]


class Top:
    """The k best (document, score) so far and the score to reach."""

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.document = self.score = np.zeros(0, dtype=np.int64)

    def add(self, document: np.ndarray, score: np.ndarray) -> None:
        good = np.flatnonzero(score >= max(self.floor, 1))
        self.document = np.concatenate([self.document, document[good]])
        self.score = np.concatenate([self.score, score[good]])
        order = np.lexsort((self.document, -self.score))[: self.k]
        self.document, self.score = self.document[order], self.score[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return self.document, self.score


def _answered(
    table: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray,
    documents: int, total: int, best: int,
) -> DataFrame:
    """(query, id, score): the best of every shard for every query, by number."""
    sent = table.sparkSession.sparkContext.broadcast((queries, weights))

    def rank(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, worth = sent.value
        # ids in order, nulls last, so that a document's place stands for its id
        shard = shard.take(pc.sort_indices(shard.column("id"))).combine_chunks()
        lists = shard.column("terms").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(shard)), sizes)
        values = [
            shard.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            for c in ("terms", "counts")
        ]
        index = Shard(shard.column("n").to_numpy(), owner, *values, worth, documents, total)
        for q, (codes, times) in enumerate(asked):
            document, score = index.best(codes, times, best)
            if len(document):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(score), q), pa.int32()),
                        shard.column("id").take(pa.array(document)).combine_chunks(),
                        pa.array(score, pa.int64()),
                    ],
                    names=["query", "id", "score"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                held.append(batch.slice(start, SHARD_ROWS))
                rows += held[-1].num_rows
                if rows >= SHARD_ROWS:
                    yield from rank(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield from rank(pa.Table.from_batches(held))

    kind = table.select(F.lit(0).alias("query"), "id", F.lit(0).cast("long").alias("score")).schema
    return table.where(F.size("terms") > 0).mapInArrow(answer, kind)


def _ranked(found: DataFrame, best: int) -> DataFrame:
    """The best of each query: first within slices of its candidates, then of those."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    cut = found.withColumn("slice", F.pmod(F.xxhash64("id", "score"), F.lit(32)))
    first = Window.partitionBy("query", "slice").orderBy(*order)
    last = Window.partitionBy("query").orderBy(*order)
    kept = cut.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= best)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item, rank, id, score): the ``best`` documents of each item."""
    asked = items.select(
        F.col(f"`{item}`").alias("item"), text_of(F.col(f"`{item_text}`")).alias("text")
    ).groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    asked = stored(asked, "search-items")
    n = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    parts = [
        _search_block(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b), best, key, text)
        for b in range(n)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def _search_block(docs: DataFrame, asked: DataFrame, best: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.select("item", F.col("text").cast("binary")).collect()  # BLOCK_BYTES at most
    words = [_query_terms(bytes(r.text)) for r in rows]
    terms = sorted({w for ws in words for w in ws})
    codes = {w: i for i, w in enumerate(terms)}
    table = stored(_lookup(docs, terms, key, text), "query-postings")
    documents, total = table.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    held = np.zeros(len(terms), dtype=np.int64)
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r["term"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1))).astype(np.int64)
    queries = []
    for ws in words:
        found, times = np.unique(np.array([codes[w] for w in ws], dtype=np.int64), return_counts=True)
        queries.append((found, times.astype(np.int64)))
    answers = _answered(table, queries, weights, documents, total or 0, best)
    names = spark.createDataFrame(
        [(i, r["item"]) for i, r in enumerate(rows)],
        asked.select(F.lit(0).alias("query"), "item").schema,
    )
    return _ranked(answers, best).join(F.broadcast(names), "query").select(
        "item", "rank", "id", "score"
    )
