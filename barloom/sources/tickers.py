"""Ticker listing as a table partitioned by market and active flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import TICKER_COLUMNS

SHARDS = ["market", "active"]
_PLAIN = [c for c in TICKER_COLUMNS if c not in SHARDS]
STORED = T.StructType(
    [T.StructField(c, T.StringType()) for c in _PLAIN]
    + [T.StructField("market", T.StringType()), T.StructField("active", T.BooleanType())]
)


def write_tickers(tickers: DataFrame, root: str) -> None:
    """Replace the market x active shards present in the rows."""
    (
        tickers.select(*TICKER_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SHARDS)
        .parquet(root)
    )


def read_tickers(
    spark: SparkSession,
    root: str,
    *,
    markets: list[str] | None = None,
    active: bool | None = None,
) -> DataFrame:
    """Shards of the given markets and state; both filters prune partitions."""
    rows = spark.read.schema(STORED).parquet(root)
    if markets:
        rows = rows.filter(F.col("market").isin(markets))
    if active is not None:
        rows = rows.filter(F.col("active") == active)
    return rows.select(*TICKER_COLUMNS)


def inventory(tickers: DataFrame) -> DataFrame:
    """Rows per shard."""
    return tickers.groupBy(*SHARDS).agg(F.count("*").alias("row_count"))
