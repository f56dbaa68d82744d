"""Risk-free rate from a yield series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import DAY, KEY, on_track


def yield_quotes(bars: DataFrame) -> DataFrame:
    """Last known daily yield (percent) of each series as a rate, with its date."""
    known = on_track(bars, DAY).filter("close IS NOT NULL AND session_end_date IS NOT NULL")
    return known.groupBy(KEY).agg(
        (F.max_by("close", "session_end_date") / 100).alias("rate"),
        F.max("session_end_date").alias("as_of"),
    )


def resolve_rates(requests: DataFrame, quotes: DataFrame, static_rate: float) -> DataFrame:
    """Rate per request: explicit value, else the quote of its series, else the static one.

    Requests carry ``explicit_rate`` and ``series_key``; either may be null.
    """
    quoted = quotes.select(F.col(KEY).alias("series_key"), "rate", "as_of")
    source = (
        F.when(F.col("explicit_rate").isNotNull(), "explicit")
        .when(F.col("rate").isNotNull(), "series")
        .otherwise("static")
    )
    return (
        requests.join(quoted, "series_key", "left")
        .withColumn("source", source)
        .withColumn(
            "risk_free_rate", F.coalesce("explicit_rate", "rate", F.lit(float(static_rate)))
        )
        .withColumn("as_of", F.when(F.col("source") == "series", F.col("as_of")))
        .drop("rate")
    )
