"""Price panels and returns in long form, for many universes at once.

A universe table has ``(universe, instrument_key, symbol)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.adjust import adjust_dividends, adjust_splits
from barloom.operators.filters import Bound, filter_range
from barloom.operators.lookup import lookup_join
from barloom.operators.resample import resample_days
from barloom.schema import (
    DAY,
    KEY,
    MIN_COVERAGE,
    TRADING_DAYS_PER_YEAR,
    WEEKS_PER_YEAR,
    on_track,
)

MIN_SYMBOLS = 2
MIN_DATES = 5
MIN_RETURNS = 2


def periods_per_year(timescale: str, trading_days: float = TRADING_DAYS_PER_YEAR) -> float:
    return WEEKS_PER_YEAR if timescale == "week" else float(trading_days)


def panel_closes(
    bars: DataFrame,
    universes: DataFrame,
    *,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
    start: Bound = None,
    end: Bound = None,
    timescale: str = "day",
) -> DataFrame:
    """Adjusted last close per universe, symbol and date (daily stock bars only)."""
    if timescale not in ("day", "week"):
        raise ValueError(f"timescale must be day or week, got {timescale!r}")
    wanted = ["window_start", "session_end_date", "ticker", "open", "high", "low", "close"]
    bars = filter_range(on_track(bars, DAY), start, end).select(KEY, *wanted)
    bars = bars.filter(F.startswith(KEY, F.lit("stocks:")))
    if splits is not None:
        bars = adjust_splits(bars, splits)
    if dividends is not None:
        bars = adjust_dividends(bars, dividends)
    if timescale == "week":
        bars = resample_days(bars, 7, week_aligned=True)
    member = universes.select("universe", KEY, "symbol").distinct()
    joined = lookup_join(
        bars.select(KEY, "window_start", "close"), member, [KEY], how="inner",
        bounded_by=universes,
    )
    return joined.groupBy(
        "universe", "symbol", F.to_date("window_start").alias("date")
    ).agg(F.max_by(F.col("close").cast("double"), "window_start").alias("close"))


def panel_coverage(closes: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Share of the universe's dates each symbol has, and whether it is kept."""
    dates = (
        closes.groupBy("universe", "date")
        .agg(F.count("close").alias("_n"))
        .groupBy("universe")
        .agg(F.count("*").alias("n_dates"))
    )
    held = closes.groupBy("universe", "symbol").agg(F.count("close").alias("n_obs"))
    return (
        held.join(dates, "universe")
        .withColumn("coverage", F.col("n_obs") / F.col("n_dates"))
        .withColumn("kept", F.col("coverage") >= min_coverage)
    )


def price_panel(
    closes: DataFrame, universes: DataFrame, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Kept symbols on the dates where all of them have a price.

    Universes left with fewer than two symbols or five dates yield no rows;
    :func:`panel_status` names them.
    """
    members = W.partitionBy("universe")
    kept = (
        panel_coverage(closes, min_coverage)
        .filter("kept")
        .select("universe", "symbol", F.count("*").over(members).alias("_symbols"))
        .filter(F.col("_symbols") >= MIN_SYMBOLS)
    )
    joined = lookup_join(
        closes.filter("close IS NOT NULL"), kept, ["universe", "symbol"], how="inner",
        bounded_by=universes,
    )
    on_date = W.partitionBy("universe", "date")
    of_symbol = W.partitionBy("universe", "symbol")
    return (
        joined.withColumn("_present", F.count("*").over(on_date))
        .filter("_present = _symbols")
        .withColumn("_dates", F.count("*").over(of_symbol))
        .filter(F.col("_dates") >= MIN_DATES)
        .select("universe", "symbol", "date", "close")
    )


def panel_status(
    closes: DataFrame, universes: DataFrame, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Per universe: symbols kept and dropped, common dates, and what is wrong."""
    report = panel_coverage(closes, min_coverage)
    asked = universes.groupBy("universe").agg(F.count_distinct("symbol").alias("n_asked"))
    kept = report.groupBy("universe").agg(F.count_if("kept").alias("n_kept"))
    panel = price_panel(closes, universes, min_coverage)
    dates = panel.groupBy("universe", "symbol").agg(F.count("*").alias("_d")).groupBy(
        "universe"
    ).agg(F.max("_d").alias("n_dates"))
    status = (
        F.when(F.col("n_kept") == 0, "no_prices")
        .when(F.col("n_kept") < MIN_SYMBOLS, "too_few_symbols")
        .when(F.col("n_dates") == 0, "too_few_dates")
        .otherwise("ok")
    )
    return (
        asked.join(kept, "universe", "left")
        .join(dates, "universe", "left")
        .na.fill(0, ["n_kept", "n_dates"])
        .withColumn("n_dropped", F.col("n_asked") - F.col("n_kept"))
        .withColumn("status", status)
        .drop("n_asked")
    )


def returns(panel: DataFrame, kind: str = "simple") -> DataFrame:
    """Simple or log return to the previous date; the first date has none.

    A date on which any symbol of the universe has no return (a zero or missing
    close before it, a log of a price that is not positive) is left out for the
    whole universe, so that all symbols keep the same dates.
    """
    if kind not in ("simple", "log"):
        raise ValueError(f"kind must be simple or log, got {kind!r}")
    of_symbol = W.partitionBy("universe", "symbol")
    on_date = W.partitionBy("universe", "date")
    growth = F.try_divide("close", F.lag("close").over(of_symbol.orderBy("date")))
    value = F.ln(F.when(growth > 0, growth)) if kind == "log" else growth - 1.0
    symbols = panel.groupBy("universe").agg(F.count_distinct("symbol").alias("_symbols"))
    return (
        panel.withColumn("ret", value)
        .filter("ret IS NOT NULL")
        .withColumn("_present", F.count("*").over(on_date))
        .join(symbols, "universe")
        .filter("_present = _symbols")
        .withColumn("_n", F.count("*").over(of_symbol))
        .filter(F.col("_n") >= MIN_RETURNS)
        .select("universe", "symbol", "date", "ret")
    )


def wide(panel: DataFrame, symbols: list[str], value: str = "close") -> DataFrame:
    """Output edge: one column per given symbol."""
    return panel.groupBy("universe", "date").pivot("symbol", symbols).agg(F.first(value))


def latest_prices(panel: DataFrame) -> DataFrame:
    """Last positive price per universe and symbol."""
    return (
        panel.groupBy("universe", "symbol")
        .agg(F.max_by("close", "date").alias("price"))
        .filter("price > 0")
    )
