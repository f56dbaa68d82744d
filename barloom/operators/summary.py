"""Distinct values, instrument summaries and recent performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.filters import parse_bound
from barloom.operators.roll import active_contract
from barloom.schema import DAY, KEY, on_track

# Listing columns whose values are offered as filters.
VALUE_COLUMNS = ["market", "type", "primary_exchange", "currency_name"]


def distinct_values(rows: DataFrame, columns: list[str] = VALUE_COLUMNS) -> DataFrame:
    """Counts of every non-empty value of the given columns, in one pass."""
    present = [c for c in columns if c in rows.columns]
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in present])
    return (
        texts.unpivot([], present, "column", "value")
        .filter(F.length("value") > 0)
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
        .orderBy("column", F.desc("count"), "value")
    )


def instrument_summary(bars: DataFrame, chain: DataFrame, today: str) -> DataFrame:
    """First and last bar, bar count, active contract and its tick per instrument."""
    held = bars.groupBy(KEY).agg(
        F.min("window_start").alias("first_bar"),
        F.max("window_start").alias("last_bar"),
        F.count("*").alias("total_candles"),
    )
    dated = held.withColumn("day", F.lit(today).cast("date"))
    return active_contract(dated, chain).select(
        KEY,
        "first_bar",
        "last_bar",
        "total_candles",
        "active_ticker",
        F.col("active_tick_size").alias("tick_size"),
    )


def futures_summary(bars: DataFrame, chain: DataFrame, today: str) -> DataFrame:
    """Tickers present, current contract, its last trade date and days to maturity."""
    day = F.lit(today).cast("date")
    held = (
        bars.groupBy(KEY, "ticker")
        .agg(F.count("*").alias("_n"))
        .groupBy(KEY)
        .agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
        .withColumn("day", day)
    )
    return active_contract(held, chain).select(
        KEY,
        "tickers",
        F.col("active_ticker").alias("current_ticker"),
        F.col("active_tick_size").alias("trade_tick_size"),
        F.col("active_last_trade_date").alias("last_trade_date"),
        F.date_diff("active_last_trade_date", day).alias("days_to_maturity"),
    )


def window_performance(bars: DataFrame, now: str, days: int) -> DataFrame:
    """Daily closes of the last days and their change in percent; null below two points."""
    moment = parse_bound(now)
    cutoff = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(
        F.lit(days)
    )
    point = F.struct("window_start", "close")
    recent = (
        on_track(bars, DAY)
        .filter((F.col("window_start") >= cutoff) & F.col("close").isNotNull())
        .groupBy(KEY)
        .agg(
            F.min_by("close", "window_start").alias("first_close"),
            F.max_by("close", "window_start").alias("last_close"),
            F.min("window_start").alias("first_date"),
            F.max("window_start").alias("last_date"),
            F.count("*").alias("points"),
            F.array_sort(F.collect_list(point)).alias("_points"),
        )
    )
    change = (F.col("last_close") - F.col("first_close")) / F.abs(
        F.nullif("first_close", F.lit(0.0))
    )
    enough = F.col("points") >= 2
    return recent.select(
        KEY,
        "points",
        F.when(enough, change * 100).alias("performance_pct"),
        F.when(enough, F.col("first_date")).alias("first_date"),
        F.when(enough, F.col("last_date")).alias("last_date"),
        F.when(enough, F.transform("_points", lambda p: p.close))
        .otherwise(F.array().cast("array<double>"))
        .alias("closes"),
    )


def dashboard_cards(
    instruments: DataFrame, names: DataFrame, bars: DataFrame, now: str, days: int
) -> DataFrame:
    """One card per instrument: display name, performance and date range."""
    recent = window_performance(bars, now, days)
    return (
        instruments.join(names, KEY, "left")
        .join(recent, KEY, "left")
        .select(
            KEY,
            "instrument_type",
            "symbol",
            F.coalesce("name", "symbol").alias("name"),
            "performance_pct",
            F.coalesce(F.col("points") >= 2, F.lit(False)).alias("has_1day"),
            "first_date",
            "last_date",
        )
    )
