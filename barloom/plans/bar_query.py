"""The bar query over any number of instruments: one lazy plan.

Only multi-day and weekly bars start a job first: the first and last session of every instrument
are written once, so that the bars are not read twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.clock import clock_seconds
from barloom.operators.adjust import adjust_dividends, adjust_splits
from barloom.operators.filters import (
    Bound,
    filter_intraday,
    filter_range,
    first_bars,
    latest_page,
    parse_bound,
    select_columns,
)
from barloom.operators.resample import (
    parse_timescale,
    resample_days,
    resample_minutes,
    session_bounds,
)
from barloom.operators.roll import adjust_rolls, dedupe_timestamps
from barloom.operators.ticks import failing_tickers, normalize_ticks, tick_quality
from barloom.schema import DAY, KEY, MINUTE
from barloom.session import materialize
from barloom.sources import store


@dataclass(frozen=True)
class BarQuery:
    """What to return; every step is optional except the track."""

    timescale: str = "1min"
    start: Bound = None
    end: Bound = None
    begin: str | None = None
    finish: str | None = None
    timezone: str = "UTC"
    adjust: bool = False
    split_adjust: bool = True
    normalize_ticks: bool = False
    dedupe: bool = True
    limit: int | None = None
    columns: list[str] | None = None

    def check(self, *, has_chain: bool) -> dict:
        """Reject combinations without a meaning, before any plan is built."""
        scale = parse_timescale(self.timescale)
        if self.adjust and self.normalize_ticks:
            raise ValueError("adjusted prices are not on the tick grid: choose one")
        if self.begin is not None and self.finish is not None:
            if clock_seconds(self.begin) == clock_seconds(self.finish):
                raise ValueError("intraday begin and finish must differ")
        if min(scale["k_minutes"], scale["k_days"]) < 1:
            raise ValueError("the time scale must be at least one unit")
        if self.normalize_ticks and not has_chain:
            raise ValueError("tick normalisation needs a roll chain")
        if self.normalize_ticks and scale["resolution"] == DAY:
            raise ValueError("tick normalisation does not apply to daily bars")
        return scale


def _adjusted(
    bars: DataFrame,
    query: BarQuery,
    resolution: str,
    splits: DataFrame | None,
    dividends: DataFrame | None,
    chain: DataFrame | None,
) -> DataFrame:
    """Splits and dividends apply to stocks, rolls to futures on the minute track."""
    stock = F.startswith(KEY, F.lit("stocks:"))
    if query.split_adjust and splits is not None:
        bars = adjust_splits(bars, splits.filter(stock))
    if query.adjust and dividends is not None:
        bars = adjust_dividends(bars, dividends.filter(stock))
    if query.adjust and chain is not None and resolution == MINUTE:
        bars = adjust_rolls(bars, chain)
    return bars


def _in_range(bars: DataFrame, query: BarQuery, resolution: str) -> DataFrame:
    if "resolution" in bars.columns:
        bars = bars.filter(F.col("resolution") == resolution)
    return filter_range(bars, query.start, query.end)


def before_quality(
    bars: DataFrame,
    query: BarQuery,
    *,
    chain: DataFrame | None = None,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
) -> DataFrame:
    """Track, range, adjustment and intraday filter: the rows the tick check looks at."""
    resolution = query.check(has_chain=chain is not None)["resolution"]
    bars = _in_range(bars, query, resolution)
    bars = _adjusted(bars, query, resolution, splits, dividends, chain)
    if resolution == MINUTE and query.begin is not None and query.finish is not None:
        bars = filter_intraday(bars, query.begin, query.finish, query.timezone)
    return bars


def query_bars(
    bars: DataFrame,
    query: BarQuery,
    *,
    chain: DataFrame | None = None,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
) -> DataFrame:
    """Range, adjust, intraday, dedupe, tick grid, resample, limit, columns: in this order.

    ``limit`` counts per instrument. Actions are those of the queried track.
    """
    scale = query.check(has_chain=chain is not None)
    rows = before_quality(bars, query, chain=chain, splits=splits, dividends=dividends)
    if query.dedupe:
        rows = dedupe_timestamps(rows, chain)
    if query.normalize_ticks:
        rows = normalize_ticks(rows, chain)
    if scale["resolution"] == DAY and scale["k_days"] > 1:
        # Adjusting and folding duplicates leave every instrument's first and last day alone.
        bounds = materialize(session_bounds(_in_range(bars, query, DAY)), "session-bounds")
        rows = resample_days(
            rows, scale["k_days"], week_aligned=scale["week_aligned"], bounds=bounds
        )
    elif scale["k_minutes"] > 1:
        rows = resample_minutes(
            rows, scale["k_minutes"], begin=query.begin, end=query.finish,
            timezone=query.timezone,
        )
    if query.limit is not None and query.limit > 0:
        rows = first_bars(rows, query.limit)
    return rows if query.columns is None else select_columns(rows, query.columns)


def query_quality(
    bars: DataFrame,
    query: BarQuery,
    chain: DataFrame,
    *,
    trigger: float = 0.1,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
) -> DataFrame:
    """Tick report over the rows of a query, before duplicates are folded."""
    rows = before_quality(bars, query, chain=chain, splits=splits, dividends=dividends)
    return tick_quality(rows, chain, trigger)


def query_gate(
    bars: DataFrame,
    query: BarQuery,
    chain: DataFrame,
    *,
    trigger: float = 0.1,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
) -> DataFrame:
    """Tickers for which the query must not be answered: too many of its rows are off the grid."""
    return failing_tickers(
        query_quality(bars, query, chain, trigger=trigger, splits=splits, dividends=dividends)
    )


def _month_of_page(log: DataFrame, query: BarQuery, n: int) -> str | None:
    """The month from which on every series surely has ``n`` bars of the query's time scale.

    A bar takes up k base bars at most, and a session drops one bar at most, so
    the rows that the manifest counts per month bound a page from below. Of
    tickers that may trade at the same minutes the busiest counts. The month
    itself isn't counted, as its first session may have begun before it. None:
    read from the start.
    """
    scale = query.check(has_chain=True)
    if query.begin is not None or scale["k_days"] > 1:
        return None
    last = parse_bound(query.end, is_end=True)
    if last is not None:  # of the month of the end only a part may be asked for
        log = log.where(F.col("month") < last.strftime("%Y-%m"))
    k = scale["k_minutes"]
    dropped = 32 if k > 1 else 0
    busiest = log.groupBy(KEY, "resolution", "month", "ticker").agg(F.sum("row_count").alias("rows"))
    months = busiest.groupBy(KEY, "resolution", "month").agg(F.max("rows").alias("rows"))
    surely = F.greatest(F.lit(0), F.floor(F.col("rows") / k) - dropped)
    later = W.partitionBy(KEY, "resolution").orderBy(F.desc("month")).rowsBetween(
        W.unboundedPreceding, -1
    )
    reached = months.withColumn("held", F.coalesce(F.sum(surely).over(later), F.lit(0)))
    start = reached.groupBy(KEY, "resolution").agg(
        F.max(F.when(F.col("held") >= n, F.col("month"))).alias("start")
    )
    # a series with too few bars for a page is read whole
    row = start.agg(F.min("start").alias("start"), F.bool_and(F.col("start").isNotNull()).alias("all"))
    found = row.first()
    return found["start"] if found["all"] else None


def query_latest_page(
    spark: SparkSession,
    root: str,
    query: BarQuery,
    n: int,
    *,
    instrument_type: str | None = None,
    symbols: list[str] | None = None,
    chain: DataFrame | None = None,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
) -> DataFrame:
    """The last ``n`` bars of the query per instrument, from a stored table.

    The manifest tells from which month on the page lies; only from there bars
    are read, adjusted and resampled.
    """
    resolution = parse_timescale(query.timescale)["resolution"]
    log = store.bars_log(spark, root).where(F.col("resolution") == resolution)
    if instrument_type is not None:
        log = log.where(F.col("instrument_type") == instrument_type)
    if symbols is not None:
        log = log.where(F.substring_index(KEY, ":", -1).isin(symbols))
    bars = store.read_bars(
        spark, root, instrument_type=instrument_type, symbols=symbols, resolution=resolution,
        months=(_month_of_page(log, query, n), None),
    )
    rows = query_bars(bars, query, chain=chain, splits=splits, dividends=dividends)
    return latest_page(rows, n)
