"""Clock-aligned k-minute bars over a stream of minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import VOLUMES, track


def tumbling_bars(
    bars: DataFrame, k_minutes: int, *, overlap: str = "1 day", by: list[str] | None = None
) -> DataFrame:
    """k-minute bars by the clock from merged minutes; streamed rows later than ``overlap`` go.

    Of a minute that a stream sends again inside the overlap the first arrival
    counts: raw runs, in which a later run corrects a minute, go through
    :func:`barloom.streaming.merge.start_bars`. The session-anchored form needs a
    session's first bar and therefore stays a batch operator.
    """
    timed = bars.withColumn("event_time", F.col("window_start").cast("timestamp")).withWatermark(
        "event_time", overlap
    )
    minute = [*track(bars), "ticker", "window_start"]
    if bars.isStreaming:
        once = timed.dropDuplicatesWithinWatermark(minute)
    else:
        once = timed.dropDuplicates(minute)
    sums = [F.sum(c).alias(c) for c in VOLUMES if c in bars.columns]
    grouped = once.groupBy(*(by or track(bars)), F.window("event_time", f"{k_minutes} minutes").alias("w")).agg(
        F.min_by("open", "event_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "event_time").alias("close"),
        F.count("*").cast("int").alias("candle_count"),
        *sums,
    )
    return grouped.withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")
