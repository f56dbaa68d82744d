"""Session-anchored minute bars and multi-day or weekly bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.clock import clock_seconds, wall_to_utc
from barloom.operators.lookup import lookup_join
from barloom.schema import DAY, MINUTE, VOLUMES, track
from barloom.session import materialize

# Time-scale units and what one of them means on its base track.
UNITS = {"min": (MINUTE, 1), "hour": (MINUTE, 60), "day": (DAY, 1), "week": (DAY, 7)}


def parse_timescale(text: str) -> dict:
    """``"15min"``, ``"2hour"``, ``"3day"`` or ``"1week"`` as resample arguments."""
    found = re.fullmatch(r"(\d*)(min|hour|day|week)", text.strip().lower())
    if not found:
        raise ValueError(f"unknown time scale {text!r}")
    resolution, size = UNITS[found[2]]
    k = int(found[1] or 1) * size
    return {
        "resolution": resolution,
        "k_minutes": k if resolution == MINUTE else 1,
        "k_days": k if resolution == DAY else 1,
        "week_aligned": found[2] == "week",
    }


def _add(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds)


def _partial_aggregates(bars: DataFrame) -> list[Column]:
    """First/last by time and extremes, all fixed-width so that hashing applies."""
    out = [
        F.min_by("open", "window_start").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "window_start").alias("close"),
        F.count("*").alias("candle_count"),
        F.min("window_start").alias("_first"),
        F.max("window_start").alias("_last"),
    ]
    out += [F.sum(c).alias(c) for c in VOLUMES if c in bars.columns]
    if "settlement_price" in bars.columns:
        out.append(
            F.min_by("settlement_price", "window_start").alias("settlement_price")
        )
    return out


def _combine_tickers(parts: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """Fold the per-ticker parts of a bucket; only a roll leaves more than one."""
    first, last = F.struct("_first", "ticker"), F.struct("_last", "ticker")
    out = [
        F.min_by("open", first).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", last).alias("close"),
        F.sum("candle_count").cast("int").alias("candle_count"),
        F.min_by("ticker", first).alias("ticker"),
    ]
    out += [F.sum(c).alias(c) for c in VOLUMES if c in parts.columns]
    if "settlement_price" in parts.columns:
        out.append(F.min_by("settlement_price", first).alias("settlement_price"))
    return parts.groupBy(*keys).agg(*out, *extra)


def resample_minutes(
    bars: DataFrame,
    k_minutes: int,
    *,
    begin: str | None = None,
    end: str | None = None,
    timezone: str | Column = "UTC",
) -> DataFrame:
    """k-minute bars on a grid anchored at each session's start.

    Buckets that would end after the session are dropped; gaps inside it stay.
    With intraday bounds the session is ``begin``..``end`` in ``timezone``
    (starting the evening before when begin > end), otherwise it runs from the
    session's first bar to one minute after its last.

    Tracks of one instrument are resampled apart. The only shuffle of the bars is
    on (instrument, track, session); both aggregations reuse it, and a session is
    at most a day of one instrument.
    """
    if k_minutes < 1:
        raise ValueError(f"k_minutes must be at least 1, got {k_minutes}")
    if k_minutes == 1:
        return _counted(bars)
    day, series = F.col("session_end_date"), track(bars)
    if begin is not None and end is not None:
        first, last = clock_seconds(begin), clock_seconds(end)
        anchor = wall_to_utc(day, first, timezone, -1 if first > last else 0)
        session_end = wall_to_utc(day, last, timezone)
    else:
        session = W.partitionBy(*series, "session_end_date")
        anchor = F.min("window_start").over(session)
        session_end = _add(F.max("window_start").over(session), F.lit(60))
    step = k_minutes * 60
    bucket = F.floor(
        F.timestamp_diff("MINUTE", F.col("_anchor"), F.col("window_start")) / k_minutes
    )
    marked = (
        bars.withColumns({"_anchor": anchor, "_session_end": session_end})
        .withColumn("_bucket", bucket)
        .withColumn("_start", _add(F.col("_anchor"), F.col("_bucket") * step))
        .filter(_add(F.col("_start"), F.lit(step)) <= F.col("_session_end"))
    )
    keys = [*series, "session_end_date", "_start"]
    if "ticker" not in bars.columns:
        marked = marked.withColumn("ticker", F.lit(None).cast("string"))
    parts = marked.groupBy(*keys, "ticker").agg(*_partial_aggregates(bars))
    return _combine_tickers(parts, keys, []).withColumnRenamed("_start", "window_start")


def session_bounds(bars: DataFrame) -> DataFrame:
    """First and last session per instrument and track, combined map-side."""
    return bars.groupBy(*track(bars)).agg(
        F.min("session_end_date").alias("first_date"),
        F.max("session_end_date").alias("last_date"),
    )


def resample_days(
    bars: DataFrame,
    k_days: int,
    *,
    week_aligned: bool = False,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """k-day bars from the first session, or ISO weeks from the first Monday.

    Every bucket with a bar is kept, except a last one whose calendar window
    the data have not yet covered. ``bounds`` (first and last session per
    instrument and track, e.g. from the manifest) saves a pass over two columns;
    without it they are computed and written once.
    """
    if k_days < 1:
        raise ValueError(f"k_days must be at least 1, got {k_days}")
    if k_days == 1:
        return _counted(bars)
    if week_aligned and k_days % 7:
        raise ValueError(f"week alignment needs a multiple of 7 days, got {k_days}")
    bounds = materialize(session_bounds(bars), "session-bounds") if bounds is None else bounds
    day = F.col("session_end_date")
    anchor = F.col("first_date")
    if week_aligned:
        anchor = F.trunc(anchor, "week").cast("date")
    series = [c for c in track(bars) if c in bounds.columns]
    joined = lookup_join(
        bars, bounds, series, how="inner", spread_by=[*series, "session_end_date"]
    )
    period = F.trunc(day, "week").cast("date") if week_aligned else day
    marked = joined.withColumn("_anchor", anchor).withColumn(
        "_bucket", F.floor(F.date_diff(period, F.col("_anchor")) / k_days).cast("int")
    )
    # Every bucket but the last ends before the last session, so this drops only a partial one.
    bucket_end = F.date_add(F.col("_anchor"), ((F.col("_bucket") + 1) * k_days - 1).cast("int"))
    marked = marked.filter(bucket_end <= F.col("last_date"))
    keys = [*track(bars), "_bucket"]
    if "ticker" not in bars.columns:
        marked = marked.withColumn("ticker", F.lit(None).cast("string"))
    parts = marked.groupBy(*keys, "ticker").agg(
        *_partial_aggregates(bars.drop("settlement_price")),
        F.min("session_end_date").alias("_day"),
    )
    extra = [F.min("_day").alias("session_end_date"), F.min("_first").alias("window_start")]
    return _combine_tickers(parts, keys, extra).drop("_bucket")


def _counted(bars: DataFrame) -> DataFrame:
    if "candle_count" in bars.columns:
        return bars
    return bars.withColumn("candle_count", F.lit(1))
