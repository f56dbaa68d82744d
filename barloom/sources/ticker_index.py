"""Inverted index of the listing: substring search that reads only the query's grams.

Two tables lie below the index's root. ``rows`` is the listing, numbered and
partitioned by blocks of row numbers. ``postings`` has one row per gram and
listing row: grams are the substrings of one to GRAM characters of the
lower-case ticker and name. They are partitioned by a checksum of the gram and
sorted into ranges of (gram, row number), so that a lookup prunes to a few
folders and row groups, and a gram that most rows hold spreads over files.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.tickers import search_tickers
from barloom.schema import TICKER_COLUMNS

GRAM = 3
#: Folders of postings.
BUCKETS = 64
#: Row numbers per block of the listing, as a power of two.
BLOCK_BITS = 16

_ROWS = T.StructType(
    [
        *[
            T.StructField(c, T.BooleanType() if c == "active" else T.StringType())
            for c in TICKER_COLUMNS
        ],
        T.StructField("row_id", T.LongType()),
        T.StructField("block", T.LongType()),
    ]
)
_POSTINGS = T.StructType(
    [
        T.StructField("gram", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)


def _grams(text: Column) -> Column:
    """All substrings of one to GRAM characters, each once; none of a null text."""
    text = F.lower(F.coalesce(text, F.lit("")))

    def of_size(size: int) -> Column:
        starts = F.when(
            F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    return F.array_distinct(F.concat(*[of_size(size) for size in range(1, GRAM + 1)]))


def grams_of_query(query: str) -> list[str]:
    """The longest indexed grams that every text with the query in it must have."""
    text = query.strip().lower()
    size = min(GRAM, len(text))
    return sorted({text[i : i + size] for i in range(len(text) - size + 1)}) if size else []


def write_index(tickers: DataFrame, root: str) -> None:
    """Index a listing; an index that is there already is an error."""
    spark = tickers.sparkSession
    numbered = (
        tickers.select(*TICKER_COLUMNS)
        .withColumn("row_id", F.monotonically_increasing_id())
        .withColumn("block", F.shiftright("row_id", BLOCK_BITS))
    )
    numbered.write.mode("errorifexists").partitionBy("block").parquet(f"{root}/rows")
    grams = F.explode(F.array_union(_grams(F.col("ticker")), _grams(F.col("name"))))
    postings = _rows(spark, root).select(grams.alias("gram"), "row_id")
    order = ["bucket", "gram", "row_id"]
    (
        postings.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BUCKETS)))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .partitionBy("bucket")
        .parquet(f"{root}/postings")
    )


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(f"{root}/rows")


def candidates(spark: SparkSession, root: str, query: str) -> DataFrame:
    """Row numbers, with their blocks, of the rows that hold every gram of the query."""
    grams = grams_of_query(query)
    buckets = sorted({crc32(g.encode()) % BUCKETS for g in grams})
    held = spark.read.schema(_POSTINGS).parquet(f"{root}/postings").filter(
        F.col("bucket").isin(buckets) & F.col("gram").isin(grams)
    )
    return (
        held.groupBy("row_id")
        .agg(F.count(F.lit(1)).alias("_held"))
        .filter(F.col("_held") == len(grams))
        .select(F.shiftright("row_id", BLOCK_BITS).alias("block"), "row_id")
    )


def search_index(
    spark: SparkSession, root: str, *, query: str | None = None, **conditions
) -> DataFrame:
    """:func:`search_tickers` of the indexed listing, with the same arguments.

    The postings of the query's grams are intersected, their rows are read
    (blocks without one are pruned) and the whole query is looked for in them,
    as grams may be there in another order.
    """
    rows = _rows(spark, root)
    if query is not None and query.strip():
        rows = rows.join(candidates(spark, root, query), ["block", "row_id"], "left_semi")
    return search_tickers(rows.select(*TICKER_COLUMNS), query=query, **conditions)
