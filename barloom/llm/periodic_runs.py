"""Runs of repeated words, found by recompression.

The words of a batch of texts, as codes with a separator of its own after each text, are compressed
level by level: blocks of one symbol into one symbol, then pairs of a left and a right symbol into
one, until no level gets shorter. The levels are a run-length grammar. Equal stretches are compressed
alike but for a bounded number of symbols at their ends, so how far two places agree is answered by
climbing while whole symbols agree and descending at the first that don't: some steps a level.

A run of period q and length max(6, 4q) at least holds a point of a grid of step 2q + 1 (5 for q = 1)
from which a whole period equals the next one. Points where a few of those words agree are candidates;
the grammar extends each to both sides, which gives the run or refutes it. All candidates of a batch
are extended together. No suffix array is made, and texts are never cut: a long text is a batch of its
own.

Defined cases: a null text is the empty text, without words and runs; a null id counts as no number,
so that nothing is repeated in its text; repeated rows are texts of their own; an empty table gives
no rows; other columns are kept by ``collapsed`` unless they have the name of a new column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.base import free_name, text_of
from barloom.llm.hashing import buffers, chunks

#: Least length of a run, in words and in periods.
LEAST, PERIODS = 6, 4
#: Bytes of text compressed together, and grid points tested at once.
CHUNK_BYTES, POINTS = 1_000_000, 1 << 20

_RUNS = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.LongType()) for n in ("start", "length", "period")]
    )
)


class Level:
    """One level of the grammar: its symbols, and where the next level's symbols come from."""

    def __init__(self, symbols: np.ndarray, spans: np.ndarray):
        #: symbols, and the word at which each begins (one entry more than symbols)
        self.symbols, self.spans = symbols, spans
        #: place of each symbol's parent on the next level, first child of each parent, and
        #: whether parents are blocks of one symbol
        self.parent = self.first = None
        self.blocks = False


class Grammar:
    """Levels of recompression over word codes; ``agreed`` tells how far two places agree."""

    def __init__(self, codes: np.ndarray):
        self.levels = [Level(codes, np.arange(len(codes) + 1))]
        while len(self.levels[-1].symbols) > 1:
            before = len(self.levels[-1].symbols)
            self._blocks()
            self._pairs()
            if len(self.levels[-1].symbols) == before:
                break

    def _next(self, first: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        last = self.levels[-1]
        last.blocks = blocks
        last.first = np.append(first, len(last.symbols))
        begins = np.zeros(len(last.symbols), dtype=np.int64)
        begins[first] = 1
        last.parent = np.cumsum(begins) - 1
        self.levels.append(Level(symbols, last.spans[last.first]))

    def _blocks(self) -> None:
        """A maximal block of one symbol becomes a symbol of (symbol, length)."""
        symbols = self.levels[-1].symbols
        first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        if len(first) == len(symbols):
            return
        size = np.diff(np.append(first, len(symbols)))
        head, top = symbols[first], int(symbols.max()) + 1
        long = size > 1
        made = head.copy()
        names = head[long] * (int(size.max()) + 1) + size[long]
        made[long] = top + np.unique(names, return_inverse=True)[1]
        self._next(first, made, blocks=True)

    def _pairs(self) -> None:
        """A left symbol and the right symbol after it become one symbol of the pair."""
        symbols = self.levels[-1].symbols
        if len(symbols) < 2:
            return
        used, code = np.unique(symbols, return_inverse=True)
        side = _sides(code, len(used), len(self.levels))
        pair = np.flatnonzero(side[code[:-1]] & ~side[code[1:]])
        if not len(pair):
            return
        keep = np.ones(len(symbols), dtype=bool)
        keep[pair + 1] = False
        first = np.flatnonzero(keep)
        names = code[pair] * len(used) + code[pair + 1]
        named = code.copy()
        named[pair] = len(used) + np.unique(names, return_inverse=True)[1]
        self._next(first, named[first], blocks=False)

    def mirrored(self) -> Grammar:
        """The same grammar read from the end."""
        other = Grammar.__new__(Grammar)
        other.levels = []
        for level in self.levels:
            back = Level(level.symbols[::-1], level.spans[-1] - level.spans[::-1])
            back.blocks = level.blocks
            if level.parent is not None:
                back.parent = level.parent[-1] - level.parent[::-1]
                back.first = level.first[-1] - level.first[::-1]
            other.levels.append(back)
        return other

    def agreed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words from the places a and b on that are the same, pair by pair."""
        out = np.zeros(len(a), dtype=np.int64)
        at_a, at_b = a.copy(), b.copy()
        on = np.arange(len(a))
        stops: list[np.ndarray] = []
        for level in self.levels:
            on, stopped = self._passed(level, on, at_a, at_b, out, climbing=level.parent is not None)
            stops.append(stopped)
            if not len(on):
                break
            at_a[on], at_b[on] = level.parent[at_a[on]], level.parent[at_b[on]]
        down = np.zeros(0, dtype=np.int64)
        for k in range(len(stops) - 1, -1, -1):
            if len(down):
                below = self.levels[k]
                at_a[down], at_b[down] = below.first[at_a[down]], below.first[at_b[down]]
                self._passed(below, down, at_a, at_b, out, climbing=False)
            down = np.concatenate([down, stops[k]])
        return out

    @staticmethod
    def _passed(
        level: Level, on: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, out: np.ndarray,
        climbing: bool,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Passes equal symbols: (pairs standing where parents begin, pairs that differ here)."""
        n, risen, stopped = len(level.symbols), [], []
        while len(on):
            x, y = at_a[on], at_b[on]
            inside = (x < n) & (y < n)
            same = inside.copy()
            same[inside] = level.symbols[x[inside]] == level.symbols[y[inside]]
            stopped.append(on[~same])
            on, x, y = on[same], x[same], y[same]
            if climbing:
                both = (level.first[level.parent[x]] == x) & (level.first[level.parent[y]] == y)
                risen.append(on[both])
                on, x, y = on[~both], x[~both], y[~both]
            step = np.ones(len(on), dtype=np.int64)
            if level.blocks:  # what is left of both blocks of the one symbol
                step = np.minimum(
                    level.first[level.parent[x] + 1] - x, level.first[level.parent[y] + 1] - y
                )
            out[on] += level.spans[x + step] - level.spans[x]
            at_a[on], at_b[on] = x + step, y + step
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *risen]), np.concatenate([none, *stopped])


def _sides(code: np.ndarray, n: int, level: int) -> np.ndarray:
    """Left or right for each of n symbols: the best of some scatterings, for the most pairs."""
    best, most = None, -1
    for turn in range(3):
        mixed = (np.arange(n, dtype=np.uint64) + np.uint64(level * 3 + turn + 1)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        side = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)) == 1
        pairs = int((side[code[:-1]] & ~side[code[1:]]).sum())
        if pairs > most:
            best, most = side, pairs
    return best


def grid_points(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the grid points of all periods of texts of these sizes, in slices."""
    most = np.where(sizes >= LEAST, sizes // PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(LEAST, PERIODS * period) - 2 * period + 1
    points = (sizes[text] - 2 * period) // step + 1
    ends = np.cumsum(points)
    start = 0
    while start < len(text):
        reach = (ends[start - 1] if start else 0) + POINTS
        stop = max(int(np.searchsorted(ends, reach, side="right")), start + 1)
        often = points[start:stop]
        pair = np.repeat(np.arange(start, stop), often)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(often) - often, often)
        yield text[pair], period[pair], nth * step[pair]
        start = stop


def found_runs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order.

    ``codes`` are the words of all texts, one code behind each text that occurs nowhere else.
    """
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    held = []
    for text, period, place in grid_points(sizes):
        at = begins[text] + place
        near = np.ones(len(at), dtype=bool)
        for offset in (0 * period, period // 2, period - 1):
            near &= codes[at + offset] == codes[at + offset + period]
        held.append(np.stack([at[near], period[near]]))
    at, period = np.concatenate(held, axis=1) if held else np.zeros((2, 0), dtype=np.int64)
    if not len(at):
        return np.zeros((0, 4), dtype=np.int64)
    # only texts with candidates are compressed
    text = np.searchsorted(begins, at, side="right") - 1
    chosen, back = np.unique(text, return_inverse=True)
    words = np.repeat(begins[chosen] - _starts(sizes[chosen] + 1), sizes[chosen] + 1)
    own = _starts(sizes[chosen] + 1)
    grammar = Grammar(codes[words + np.arange(len(words))])
    at = at - begins[text] + own[back]
    n = len(words)
    after = grammar.agreed(at, at + period)
    before = grammar.mirrored().agreed(n - at, n - at - period)
    length = before + after + period
    real = np.flatnonzero(length >= np.maximum(LEAST, PERIODS * period))
    rows = np.stack(
        [chosen[back[real]], (at - before - own[back])[real], length[real], period[real]], axis=1
    )
    rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[first]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def collapsed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    runs: str = "runs",
    short: str = "collapsed",
    words: str = "n_words",
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """The documents with their runs, and the text without a run's words after its first period.

    ``edit`` may change the words of a document, given its key, before runs are sought.
    """
    dropped = {runs.lower(), short.lower(), words.lower(), text.lower()}
    kept = [c for c in docs.columns if c.lower() not in dropped]
    said = free_name([*kept, "key"], "said")
    name = free_name([*kept, said], "key")
    columns = [F.col(f"`{c}`") for c in kept]
    taken = docs.select(
        *columns, F.col(f"`{key}`").alias(name), text_of(F.col(f"`{text}`")).alias(said)
    )
    schema = docs.select(*columns).schema.add(words, "long").add(runs, _RUNS).add(short, "string")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(said))
            for i, j in chunks(offsets, CHUNK_BYTES):
                part = batch.slice(i, j - i)
                texts = [
                    data[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(i, j)
                ]
                if edit is not None:
                    texts = list(map(edit, part.column(name).to_pylist(), texts))
                sizes = np.array(list(map(len, texts)), dtype=np.int64)
                found = found_runs(_codes(texts, int(sizes.sum())), sizes)
                limits = np.searchsorted(found[:, 0], np.arange(j - i + 1))
                listed = pa.StructArray.from_arrays(
                    [pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in kept],
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(limits, pa.int32()), listed),
                        pa.array(_shortened(texts, found, limits), pa.string()),
                    ],
                    names=[*kept, words, runs, short],
                )

    return taken.mapInArrow(find, schema)


def _codes(texts: list[list[bytes]], n: int) -> np.ndarray:
    """Codes of all words, equal ones alike, and a code of its own after each text."""
    known: dict[bytes, int] = {}
    number = count()
    out = np.empty(n + len(texts), dtype=np.int64)
    at = 0
    for words in texts:
        out[at : at + len(words)] = list(map(known.setdefault, words, number))
        at += len(words)
        out[at] = next(number)
        at += 1
    return out


def _shortened(texts: list[list[bytes]], found: np.ndarray, limits: np.ndarray) -> list[bytes]:
    out = []
    for k, words in enumerate(texts):
        if limits[k] < limits[k + 1]:
            keep = bytearray(b"\1") * len(words)
            for _, start, length, period in found[limits[k] : limits[k + 1]].tolist():
                keep[start + period : start + length] = bytes(length - period)
            words = compress(words, keep)
        out.append(b" ".join(words))
    return out


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period; of equal ones the first, then the shortest period."""
    exact = F.lit(10**18).cast("decimal(19,0)")

    def rated(run: Column) -> Column:
        # periods below 10 ** 9 can't tie here without being equal
        ratio = F.floor(run.length.cast("decimal(19,0)") * exact / run.period)
        return F.struct(
            ratio.alias("ratio"), (-run.start).alias("start"), (-run.period).alias("period"), run.alias("run")
        )

    return F.array_max(F.transform(runs, rated)).getField("run")
