"""Benchmark decontamination with a broadcast hash set of the items' word windows.

Words are runs of letters, digits and code points beyond ASCII, with A-Z made small. Every item
gives the windows of LENGTH consecutive words (a shorter item is one window whole). Documents are
scanned: each of their windows is probed by hash in the broadcast set. What leaves the scan is one
small row a document and one per hit. Documents with hits are read again and every hit is verified
word by word, so results rest on words, not on hashes. The set is broadcast in blocks of BLOCK_BYTES,
as measured: a benchmark of any size is scanned for, block by block.

Defined cases: a null text has no words and is never hit; an item without words has no windows;
items of one id are one item, a null id is an item with the empty name; repeated rows are documents
of their own, told apart by their place; an empty table gives no rows, an empty benchmark no hits;
other columns are kept by ``decontaminated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import stored, text_of
from barloom.llm.exact_dedup import located

LENGTH = 10
#: Bytes of windows broadcast at once.
BLOCK_BYTES = 32_000_000

# The words of the contract.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: A word of the text as it stands, with what precedes it.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def lowered_words(text: Column) -> Column:
    small = F.translate(text_of(text), _CAPITALS, _CAPITALS.lower())
    return F.regexp_extract_all(small, F.lit(_WORD), F.lit(0))


def _windows(words: str, length: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of the words of each window of ``length``, in order; null where there is none."""
    size = F.size(words)
    starts = F.sequence(F.lit(1), size - length + 1)
    cut = F.transform(starts, lambda i: made(F.slice(words, i, length)))
    return F.when((size >= length) & (length > 0), cut)


def _hashes(words: str, length: int) -> Column:
    """Hash of each window, as ``xxhash64`` hashes the array of its words.

    Windows are read place by place: cutting each out of the array would copy
    the whole array every time.
    """
    starts = F.sequence(F.lit(0), F.size(words) - length)
    hashes = F.transform(
        starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)])
    )
    return F.when(F.size(words) >= length, hashes)


def item_grams(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (hash, gram, item): the windows of every item, by its id as text."""
    said = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"),
        lowered_words(F.col(f"`{text}`")).alias("words"),
    )
    length = F.least(F.size("words"), F.lit(LENGTH))
    gram = _windows("words", length, lambda words: words)
    return (
        said.select("item", F.explode(gram).alias("gram"))
        .select(F.xxhash64("gram").alias("hash"), "gram", "item")
        .distinct()
    )


def _blocks(pairs: DataFrame, block_bytes: int) -> tuple[list[int], list[DataFrame]]:
    """The lengths of the windows, and the distinct windows in blocks of about equal size."""
    distinct = pairs.select("hash", "gram").distinct()
    size = F.length(F.array_join("gram", " ").cast("binary")) + 64
    lengths, total = distinct.agg(F.collect_set(F.size("gram")), F.sum(size)).first()
    n = 1 + (total or 0) // block_bytes
    return sorted(lengths), [distinct.where(F.pmod("hash", F.lit(n)) == b) for b in range(n)]


def _scanned(
    rows: DataFrame, lengths: list[int], block: DataFrame, with_documents: bool
) -> DataFrame:
    """Hits of one block's windows and, with ``with_documents``, a row of place -1 per document."""
    said = rows.select("file", "row", "id", lowered_words(F.col("text")).alias("words"))
    none = F.array().cast("array<bigint>")
    hashes = [F.coalesce(_hashes("words", n), none) for n in lengths]
    probes = F.concat(F.array(F.lit(None).cast("bigint")), *hashes)
    place = ["file", "row", "id", "n_words"]
    probed = said.withColumn("n_words", F.size("words")).select(*place, F.posexplode(probes).alias("at", "hash"))
    known = F.broadcast(block.withColumnRenamed("hash", "known"))
    joined = probed.join(known, F.col("hash") == F.col("known"), "left" if with_documents else "inner")
    # windows of the n-th length come after those of the lengths before it
    before, start = F.lit(1), F.lit(-1)
    for n in lengths:
        start = F.when(F.size("gram") == n, F.col("at") - before).otherwise(start)
        before = before + F.greatest(F.lit(0), F.col("n_words") - n + 1)
    return joined.where("at = 0 OR gram IS NOT NULL").select(*place, start.alias("start"), "gram")


def _verified(words: Column) -> Column:
    """The hits in ``met`` whose words stand in the text at their place."""

    def stands(words: Column, m: Column) -> Column:
        return F.size(F.filter(m.gram, lambda w, k: F.get(words, m.start + k) == w)) == F.size(m.gram)

    # as the one element of an array the words are made once, not for each hit
    checked = F.transform(F.array(words), lambda ws: F.filter("met", lambda m: stands(ws, m)))
    return F.get(checked, F.lit(0))


def hit_places(spans: Column) -> Column:
    """The places of the words inside any of the spans."""
    inside = F.transform(spans, lambda s: F.sequence(s.start, s.start + s.length - 1))
    return F.array_distinct(F.flatten(inside))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(file, row, id, n_words, spans, items) of every document.

    ``spans`` are the places (start, length) of its windows that an item has too,
    ``items`` the sorted ids of those items.
    """
    return _contamination(located(docs, key, text), benchmark, item, item_text, block_bytes)


def _contamination(
    rows: DataFrame, benchmark: DataFrame, item: str, item_text: str, block_bytes: int
) -> DataFrame:
    pairs = stored(item_grams(benchmark, item, item_text), "item-grams")
    lengths, blocks = _blocks(pairs, block_bytes)
    scans = [_scanned(rows, lengths, block, i == 0) for i, block in enumerate(blocks)]
    scan = stored(reduce(DataFrame.unionAll, scans), "window-hits")
    place = ["file", "row"]
    met = (
        scan.where("start >= 0").groupBy(*place)
        .agg(F.collect_list(F.struct("start", "gram")).alias("met"))
    )
    same = _verified(lowered_words(F.col("text")))
    spans = F.transform(
        "same", lambda m: F.struct(m.start.alias("start"), F.size(m.gram).alias("length"))
    )
    hits = stored(
        rows.select(*place, "text").join(met, place)
        .select(*place, same.alias("same"))
        .select(*place, spans.alias("spans"), F.array_distinct("same.gram").alias("grams")),
        "verified-hits",
    )
    named = (
        hits.select(*place, F.explode("grams").alias("gram"))
        .join(pairs.select("gram", "item"), "gram")
        .groupBy(*place).agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = hits.select(*place, "spans").join(named, place)
    return scan.where("start < 0").drop("start", "gram").join(found, place, "left").select(
        *place, "id", "n_words",
        F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "spans",
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents without what they share with the benchmark.

    With ``remove="documents"`` those with a hit go; with ``"spans"`` every
    document stays, without the hit words and what stands before them. A document
    without a hit keeps its text as it is.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    rows = located(docs, key, text)
    found = _contamination(rows, benchmark, item, item_text, block_bytes)
    dirty = found.where(F.size("spans") > 0).select("file", "row", "spans")
    if remove == "documents":
        return rows.join(dirty, ["file", "row"], "left_anti").select("doc.*")
    pieces = F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))
    tail = F.regexp_extract("text", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    places = F.sequence(F.lit(0), F.size("pieces") - 1)
    kept = F.transform(F.array_except(places, "hit"), lambda i: F.get("pieces", i))
    cut = (
        rows.join(dirty.select("file", "row", hit_places(F.col("spans")).alias("hit")),
                  ["file", "row"], "left")
        .withColumn("pieces", F.when(F.col("hit").isNotNull(), pieces))
        .withColumn(
            "clean",
            F.when(F.col("hit").isNull(), F.col(f"doc.`{text}`").cast("string"))
            .otherwise(F.concat(F.array_join(kept, ""), tail)),
        )
    )
    return cut.select(
        *[
            F.col("clean").alias(c) if c.lower() == text.lower() else F.col(f"doc.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
