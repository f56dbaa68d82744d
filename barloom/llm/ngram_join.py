"""Jaccard self-join on word n-grams with MinHash prefix trees of one length.

A document's signature has a label path for each of TREES prefix trees. Two documents meet in a tree
if their paths agree on a prefix. Its length is the longest, MAX_DEPTH at most, at which a pair at
the threshold similarity meets in some tree with the target probability; it is computed before any
row is read, so that this is banding. Tree nodes with two or more members are the candidates; members are verified against each other by exact intersection of their
n-gram sets.

Documents of one word sequence are one class. Tree nodes of equal membership are verified once, and
a pair of classes only in the first tree in which it meets. A node of many members is split into
blocks, and each pair of blocks is a cell of its own: the task of a cell counts links by block
matrix products and returns, instead of pairs, a count per class and a spanning forest. So the hot
node of a large group of near copies spreads over many tasks, and no pairs are written.

Defined cases: a null or blank text has no n-grams and is similar to blank texts alone; a text of
fewer than N words is one n-gram; words are taken as they stand; repeated rows are documents of
their own and one class; null ids are kept, and are the id of a class only if it has no other; an
empty table gives no rows. Equality of n-grams and word sequences rests on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import partitions, stored
from barloom.llm.components import components
from barloom.llm.exact_dedup import located
from barloom.llm.hashing import WordHasher, buffers, chunks, grams, mixed

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES, MAX_DEPTH = 24, 12
#: Members of one block of a large tree node.
BLOCK = 512
#: Groups of cells per shuffle partition.
BUCKETS_PER_PARTITION = 8
#: Distinct n-grams multiplied at once.
COLUMNS = 4096

_NO_ID = (1 << 63) - 1


def depth_for(threshold: float, recall: float, trees: int = TREES, depth: int = MAX_DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _shingles(
    hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, first n-gram of each text, hash of each text's words, number of words)."""
    _, _, hashes, first = hasher.words(data, offsets)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(text)) - np.repeat(first[:-1], n_words)
    with np.errstate(over="ignore"):
        # the place enters by its own hash, so equal sums mean equal sequences
        placed = mixed(hashes ^ mixed(place.astype(np.uint64) + np.uint64(1)))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(placed, dtype=np.uint64)])
        sequence = mixed(total[first[1:]] - total[first[:-1]] + n_words.astype(np.uint64))
    short = n_words < n
    valid = (n_words[text] - place >= n) | (short[text] & (place == 0))
    values = np.zeros(len(text), dtype=np.uint64)
    full = grams(hashes, n)
    values[: len(full)] = full
    whole_text = short[text]
    values[whole_text] = sequence[text[whole_text]]
    at = np.flatnonzero(valid)
    counts = np.bincount(text[at], minlength=len(n_words))
    return values[at], np.concatenate([[0], np.cumsum(counts)]), sequence, n_words


def _signer(n: int, depth: int):
    """Maps batches (place, file, row, text) to (place, file, row, class, prefixes)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        random = np.random.default_rng(7)
        times = random.integers(0, 1 << 63, TREES * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = random.integers(0, 1 << 63, TREES * depth, dtype=np.uint64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                values, first, sequence, n_words = _shingles(hasher, data, offsets[i : j + 1], n)
                full = np.flatnonzero(n_words)
                prefixes = np.zeros((len(full), TREES), dtype=np.uint64)
                buffer = np.empty_like(values)
                with np.errstate(over="ignore"):
                    for k in range(TREES * depth if len(full) else 0):
                        np.multiply(values, times[k], out=buffer)
                        np.add(buffer, plus[k], out=buffer)
                        label = np.minimum.reduceat(buffer, first[:-1][full])
                        tree = prefixes[:, k // depth]
                        tree[:] = mixed(tree * np.uint64(31) + label)
                sizes = np.where(n_words > 0, TREES, 0)
                limits = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(i, j - i) for c in ("place", "file", "row")],
                        pa.array(sequence.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(limits), pa.array(prefixes.reshape(-1).view(np.int64))
                        ),
                    ],
                    names=["place", "file", "row", "class", "prefixes"],
                )

    return sign


def _gatherer(n: int):
    """Maps batches (class, text) to (class, grams): the sorted distinct n-grams as bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            wanted = batch.column("class").to_numpy()
            for i, j in chunks(offsets):
                values, first, sequence, _ = _shingles(hasher, data, offsets[i : j + 1], n)
                mine = np.flatnonzero(sequence.view(np.int64) == wanted[i:j])
                sets = [np.unique(values[first[k] : first[k + 1]]).tobytes() for k in mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[i:j][mine]), pa.array(sets, pa.binary())],
                    names=["class", "grams"],
                )

    return gather


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of 0/1 matrices."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[code] > 1
    owner, code = owner[several], code[several]
    code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    found = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        block = np.zeros((len(sets), int(code[b - 1]) - low + 1), dtype=np.float32)
        block[owner[a:b], code[a:b] - low] = 1
        found += block[: len(left)] @ block[len(left) :].T
    return found


def _trees_of(links: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component in a symmetric matrix of links."""
    label = np.arange(len(links))
    linked = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verifier(threshold: float):
    """Counts links and spans components in the cells of one bucket."""

    def verify(table: pa.Table) -> pa.Table:
        cells = table.column("cell").to_numpy()
        order = np.argsort(cells, kind="stable")
        table, cells = table.take(pa.array(order)), cells[order]
        edges = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        classes, size = (table.column(c).to_numpy() for c in ("class", "size"))
        low, high = table.column("low_block").to_numpy(), table.column("high_block").to_numpy()
        block, tree = table.column("block").to_numpy(), table.column("tree").to_numpy()
        out: dict[str, list] = {"a": [], "b": [], "links": []}
        for start, stop in zip(edges, np.append(edges[1:], len(cells)), strict=True):
            part = table.slice(start, stop - start)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("grams").to_pylist()]
            paths = np.array(part.column("prefixes").to_pylist(), dtype=np.int64)
            own, weight = classes[start:stop], size[start:stop]
            one_block = low[start] == high[start]
            first = np.flatnonzero(block[start:stop] == low[start])
            second = first if one_block else np.flatnonzero(block[start:stop] == high[start])
            if not len(first) or not len(second):
                continue
            count = np.array([len(x) for x in sets])
            common = _common([sets[k] for k in first], [sets[k] for k in second])
            union = count[first][:, None] + count[second][None, :] - common
            linked = common >= threshold * union - 1e-6
            # this tree's node brings them together, an earlier one may have done so already
            for t in range(int(tree[start])):
                linked &= paths[first, t][:, None] != paths[second, t][None, :]
            if one_block:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(own), dtype=np.int64)
            links[first] += linked @ weight[second]
            if not one_block:
                links[second] += weight[first] @ linked
            matrix = np.zeros((len(own), len(own)), dtype=bool)
            matrix[np.ix_(first, second)] = linked
            root = _trees_of(matrix | matrix.T)
            some = np.flatnonzero(links)
            out["a"].append(own[some])
            out["b"].append(own[root[some]])
            out["links"].append(links[some])
        return pa.table(
            {
                name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
                for name, x in out.items()
            }
        )

    return verify


def _linked(
    located_rows: DataFrame, n: int, threshold: float, recall: float
) -> tuple[DataFrame, DataFrame]:
    """Rows (place, file, row, class) and classes (class, rep, label, least, n_links, n_texts)."""
    spark = located_rows.sparkSession
    depth = depth_for(threshold, recall)
    said = located_rows.select(
        F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)).alias("place"), "file", "row", "text"
    )
    rows = stored(
        said.mapInArrow(
            _signer(n, depth),
            "place long, file string, row long, class long, prefixes array<long>",
        ),
        "signatures",
    )
    classes = stored(
        rows.groupBy("class").agg(
            F.count(F.lit(1)).alias("size"),
            F.min(F.struct("place", "file", "row")).alias("first"),
            F.max("prefixes").alias("prefixes"),
        ).withColumn("rep", F.col("first.place")),
        "text-classes",
    )
    entries = classes.select("class", F.posexplode("prefixes").alias("tree", "prefix"))
    nodes = (
        entries.groupBy("tree", "prefix")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.bit_xor(F.xxhash64("class")).alias("membership"),
        )
        .where("members > 1")
        .groupBy("members", "membership")
        .agg(F.min(F.struct("tree", "prefix")).alias("node"))
        .select("node.tree", "node.prefix", "members")
    )
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    other = F.col("other")
    cells = (
        entries.join(nodes, ["tree", "prefix"])
        .withColumn("block", F.pmod(F.xxhash64("class", "tree"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "class", "tree", "block",
            F.least("block", other).alias("low_block"),
            F.greatest("block", other).alias("high_block"),
            F.xxhash64(
                "tree", "prefix", F.least("block", other), F.greatest("block", other)
            ).alias("cell"),
        )
    )
    cells = stored(cells, "cells")
    # one row stands for its class, found by its place: ids may be null or repeated
    wanted = classes.join(cells.select("class").distinct(), "class").select(
        "class", "first.file", "first.row"
    )
    sets = (
        said.join(wanted, ["file", "row"])
        .select("class", "text")
        .mapInArrow(_gatherer(n), "class long, grams binary")
    )
    buckets = BUCKETS_PER_PARTITION * partitions(spark)
    filled = (
        cells.join(sets, "class")
        .join(classes.select("class", "size", "prefixes"), "class")
        .withColumn("bucket", F.pmod("cell", F.lit(buckets)))
    )
    found = stored(
        filled.groupBy("bucket").applyInArrow(_verifier(threshold), "a long, b long, links long"),
        "links",
    )
    labels = components(found.select("a", "b")).select(
        F.col("a").alias("class"), F.col("b").alias("label")
    )
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    decided = (
        classes.select("class", "size", "rep")
        .join(links, "class", "left")
        .join(labels, "class", "left")
        .select(
            "class", "rep",
            F.coalesce("label", "class").alias("label"),
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    decided = stored(decided, "text-classes-linked")
    smallest = decided.groupBy("label").agg(
        F.min("rep").alias("least"), F.count(F.lit(1)).alias("n_texts")
    )
    return rows, decided.join(smallest, "label")


def similar_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """(id, class_id, copy_of, n_links, n_texts) of every document.

    ``class_id`` is the smallest id that a chain of links leads to, ``copy_of``
    the smallest id with the same words, ``n_links`` the number of other
    documents at least ``threshold`` similar (copies included), ``n_texts`` the
    number of different texts in the class.
    """
    rows, classes = _linked(located(docs, key, text), n, threshold, recall)

    def id_(column: str) -> Column:
        return F.when(F.col(column) != F.lit(_NO_ID), F.col(column))

    return rows.select("place", "class").join(classes, "class").select(
        id_("place").alias(key),
        id_("least").alias("class_id"),
        id_("rep").alias("copy_of"),
        "n_links",
        "n_texts",
    )


def keep_one_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """The documents, all columns, one of each class: the first row with the smallest id."""
    rows = located(docs, key, text)
    signed, classes = _linked(rows, n, threshold, recall)
    placed = signed.join(classes.select("class", "label"), "class").select(
        "label", F.struct("place", "file", "row").alias("at")
    )
    first = placed.groupBy("label").agg(F.min("at").alias("first"))
    gone = placed.join(first, "label").where("at != first").select("at.file", "at.row")
    return rows.join(gone, ["file", "row"], "left_anti").select("doc.*")
