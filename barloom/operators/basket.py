"""Synthetic bars of weighted baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.lookup import lookup_join
from barloom.schema import KEY, MIN_WEIGHT, OHLC, track


def basket_legs(weights: DataFrame, bars: DataFrame, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """Legs that have bars, with weights rescaled to one, and their number.

    Both are counted per basket and track, as an instrument may trade on one only.
    """
    series = track(bars)
    whole = W.partitionBy("basket", *[c for c in series if c != KEY])
    traded = bars.select(*series).distinct()
    return (
        weights.filter(F.col("weight") >= min_weight)
        .join(traded, KEY)
        .select(
            "basket",
            *series,
            (F.col("weight") / F.sum("weight").over(whole)).alias("weight"),
            F.count("*").over(whole).alias("legs"),
        )
    )


def leg_report(weights: DataFrame, bars: DataFrame, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """Every leg on every track, with its share ``part`` or why it has none (``left_out``).

    ``bars`` may be a list of the series that have bars. Reasons are ``weight``
    (below ``min_weight``, or null) and ``no bars``.
    """
    series = track(bars)
    legs = basket_legs(weights, bars, min_weight)
    kept = legs.select("basket", *series, F.col("weight").alias("part"))
    asked = weights
    if "resolution" in series:
        tracks = F.broadcast(bars.select("resolution").distinct())
        asked = weights.join(tracks, F.lit(True), "cross")
    too_small = F.col("weight").isNull() | (F.col("weight") < min_weight)
    reason = F.when(too_small, F.lit("weight")).when(F.col("part").isNull(), F.lit("no bars"))
    return asked.join(kept, ["basket", *series], "left").withColumn("left_out", reason)


def with_legs(bars: DataFrame, legs: DataFrame, weights: DataFrame) -> DataFrame:
    """The bars of the legs, once per basket, with the leg's weight."""
    wanted = [*track(bars), "window_start", *OHLC]
    wanted += ["volume"] if "volume" in bars.columns else []
    return lookup_join(bars.select(*wanted), legs, track(bars), how="inner", bounded_by=weights)


def combined_legs(joined: DataFrame) -> DataFrame:
    """Weighted sums of the legs on the times that all legs of a basket have."""
    on = ["basket", *[c for c in track(joined) if c != KEY]]
    has_volume = "volume" in joined.columns
    volume = F.coalesce(F.col("volume"), F.lit(0)) if has_volume else F.lit(0.0)
    return (
        joined.groupBy(*on, "window_start")
        .agg(
            *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in OHLC],
            F.sum(volume * F.col("weight")).alias("volume"),
            F.count("*").alias("_present"),
            F.max("legs").alias("_legs"),
        )
        .filter("_present = _legs")
    )


def rebased(combined: DataFrame, weights: DataFrame, *, rebase: float = 100.0) -> DataFrame:
    """The sums as bars whose first close is ``rebase``; a basket needs two times and a base."""
    on = ["basket", *[c for c in combined.columns if c == "resolution"]]
    start = combined.groupBy(*on).agg(
        F.min_by("close", "window_start").alias("_base"), F.count("*").alias("_bars")
    )
    usable = start.filter("_bars >= 2 AND _base <> 0 AND NOT isnan(_base)").drop("_bars")
    based = lookup_join(combined, usable, on, how="inner", bounded_by=weights)
    factor = F.lit(float(rebase)) / F.col("_base")
    close = F.col("close") * factor
    return based.select(
        F.concat(F.lit("portfolio:"), F.col("basket")).alias(KEY),
        *on,
        "window_start",
        F.to_date("window_start").alias("session_end_date"),
        F.lit("PORTFOLIO").alias("ticker"),
        *[(F.col(c) * factor).alias(c) for c in OHLC],
        "volume",
        F.lit(0).cast("bigint").alias("transactions"),
        (close * F.col("volume")).alias("dollar_volume"),
    )


def basket_bars(bars: DataFrame, weights: DataFrame, *, rebase: float = 100.0) -> DataFrame:
    """Weighted sum of the legs on their common timestamps, first close at ``rebase``.

    Legs are combined at the base resolution, each track apart; resample the
    result afterwards. Baskets appear as instruments keyed ``portfolio:<basket>``.
    """
    joined = with_legs(bars, basket_legs(weights, bars), weights)
    return rebased(combined_legs(joined), weights, rebase=rebase)
