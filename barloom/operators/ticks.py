"""Tick-grid normalisation and quality report."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.roll import tick_sizes
from barloom.schema import KEY, PRICES, QUALITY_ERROR, QUALITY_WARNING


class DataQualityError(ValueError):
    """Raised when a ticker has too many prices off its tick grid."""


def normalize_ticks(bars: DataFrame, chain: DataFrame) -> DataFrame:
    """Prices as integer multiples of the tick.

    All price columns become integers, also those of tickers without a tick
    size, which are therefore truncated.
    """
    joined = tick_sizes(bars, chain)
    tick = F.col("tick_size")

    def to_ticks(name: str) -> Column:
        price = F.col(name)
        return F.when(tick > 0, F.rint(price / tick)).otherwise(price).cast("int")

    return joined.withColumns({c: to_ticks(c) for c in PRICES if c in bars.columns}).drop(
        "tick_size"
    )


def _status(ratio: Column) -> Column:
    return (
        F.when(ratio >= QUALITY_ERROR, "ERREUR")
        .when(ratio >= QUALITY_WARNING, "ATTENTION")
        .otherwise("OK")
    )


def tick_quality(bars: DataFrame, chain: DataFrame, trigger: float = 0.1) -> DataFrame:
    """Bars off the tick grid per ticker, plus a total per instrument (null ticker).

    A bar is counted once if any of its prices deviates. The deviation is
    measured in ticks and compared with ``trigger`` times the tick size.
    """
    joined = tick_sizes(bars, chain).filter("tick_size > 0")
    tick = F.col("tick_size")

    def off_grid(name: str) -> Column:
        ticks = F.col(name) / tick
        return F.coalesce(F.abs(ticks - F.rint(ticks)) > trigger * tick, F.lit(False))

    bad = reduce(or_, [off_grid(c) for c in PRICES if c in bars.columns])
    per_ticker = joined.groupBy(KEY, "ticker", "tick_size").agg(
        F.count("*").alias("total_candles"), F.count_if(bad).alias("bad_candles")
    )
    # The totals come from the per-ticker counts, so the bars are not expanded.
    totals = per_ticker.groupBy(KEY).agg(
        F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("double").alias("tick_size"),
        F.sum("total_candles").alias("total_candles"),
        F.sum("bad_candles").alias("bad_candles"),
    )
    ratio = F.col("bad_candles") / F.col("total_candles")
    return (
        per_ticker.unionByName(totals)
        .withColumn("ratio", ratio)
        .withColumn("status", _status(F.col("ratio")))
    )


def failing_tickers(report: DataFrame) -> DataFrame:
    """Tickers of a report that are in error; the totals of instruments are left out."""
    return report.filter((F.col("status") == "ERREUR") & F.col("ticker").isNotNull())


def assert_quality(report: DataFrame) -> None:
    """Action: raise if any ticker of the report is in error."""
    first = failing_tickers(report).limit(1).collect()
    if first:
        raise DataQualityError(f"too many prices off the tick grid: {first[0].asDict()}")
