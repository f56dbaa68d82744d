"""Split and dividend adjustment through as-of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.lookup import lookup_join
from barloom.schema import DAY, KEY, OHLC, on_track


def strict_forward_intervals(
    actions: DataFrame, date_col: str, values: list[str], *, key: str = KEY
) -> DataFrame:
    """Turn "first action dated after D" into disjoint ``[valid_from, valid_to)`` rows.

    The first action of a key is valid from the beginning of time (null). Of
    actions on one date the smallest value, which carries them all, is kept;
    the others get an empty interval.
    """
    order = W.partitionBy(key).orderBy(F.col(date_col), *[F.col(v) for v in values])
    return (
        actions.filter(F.col(date_col).isNotNull())
        .withColumn("valid_from", F.lag(date_col).over(order))
        .withColumn("valid_to", F.col(date_col))
        .select(key, "valid_from", "valid_to", *values)
        .filter(F.col("valid_from").isNull() | (F.col("valid_from") < F.col("valid_to")))
    )


def asof_next(
    facts: DataFrame,
    actions: DataFrame,
    date_col: str,
    values: list[str],
    *,
    at: Column,
    how: str = "left",
    **bounds,
) -> DataFrame:
    """As-of join, forward and strict: values of the first action dated after ``at``."""
    day = facts.withColumn("_day", at)
    inside = (F.col("valid_from").isNull() | (F.col("_day") >= F.col("valid_from"))) & (
        F.col("_day") < F.col("valid_to")
    )
    joined = lookup_join(
        day,
        strict_forward_intervals(actions, date_col, values),
        [KEY],
        condition=inside,
        how=how,
        bounded_by=bounds.pop("bounded_by", actions),
        spread_by=[KEY, "_day"],
        **bounds,
    )
    return joined.drop("_day", "valid_from", "valid_to")


def _scale(bars: DataFrame, scale: Column, columns: list[str]) -> DataFrame:
    return bars.withColumns({c: F.col(c) * scale for c in columns if c in bars.columns})


def _with_factor(bars: DataFrame, actions: DataFrame, date_col: str, **bounds) -> DataFrame:
    named = actions.select(
        KEY, date_col, F.col("historical_adjustment_factor").alias("_factor")
    )
    return asof_next(
        bars, named, date_col, ["_factor"], at=F.to_date("window_start"), **bounds
    )


def adjust_splits(bars: DataFrame, splits: DataFrame, **bounds) -> DataFrame:
    """OHLC times the cumulative factor of the first split after the bar's date."""
    joined = _with_factor(bars, splits, "execution_date", **bounds)
    factor = F.coalesce(F.nullif("_factor", F.lit(0.0)), F.lit(1.0))
    return _scale(joined, factor, OHLC).drop("_factor")


def unadjust_splits(bars: DataFrame, splits: DataFrame, **bounds) -> DataFrame:
    """Inverse of :func:`adjust_splits`, for a vendor that sends adjusted prices."""
    joined = _with_factor(bars, splits, "execution_date", **bounds)
    factor = F.lit(1.0) / F.coalesce(F.nullif("_factor", F.lit(0.0)), F.lit(1.0))
    return _scale(joined, factor, OHLC).drop("_factor")


def adjust_dividends(bars: DataFrame, dividends: DataFrame, **bounds) -> DataFrame:
    """OHLC times the cumulative factor of the first ex-date after the bar's date."""
    joined = _with_factor(bars, dividends, "ex_dividend_date", **bounds)
    return _scale(joined, F.coalesce("_factor", F.lit(1.0)), OHLC).drop("_factor")


def merged_actions(splits: DataFrame | None, dividends: DataFrame | None) -> DataFrame:
    """One row per key and date ``_date`` with the factors that hold before it.

    ``_split`` is that of the first split on or after the date, ``_dividend``
    that of the first ex-date; null where none follows. Of actions on one date
    the smallest factor, which carries them all, is kept.
    """
    kinds = {"_split": (splits, "execution_date"), "_dividend": (dividends, "ex_dividend_date")}
    dated = []
    for name, (actions, date_col) in kinds.items():
        if actions is not None:
            factors = [
                F.col("historical_adjustment_factor") if n == name else F.lit(None).cast("double")
                for n in kinds
            ]
            named = [f.alias(n) for f, n in zip(factors, kinds)]
            dated.append(actions.select(KEY, F.col(date_col).alias("_date"), *named))
    both = dated[0] if len(dated) == 1 else dated[0].unionAll(dated[1])
    per_date = both.filter("_date IS NOT NULL").groupBy(KEY, "_date").agg(
        *[F.min(n).alias(n) for n in kinds]
    )
    onwards = W.partitionBy(KEY).orderBy("_date").rowsBetween(
        W.currentRow, W.unboundedFollowing
    )
    return per_date.withColumns({n: F.first(n, ignorenulls=True).over(onwards) for n in kinds})


def adjust_actions(
    bars: DataFrame, splits: DataFrame | None, dividends: DataFrame | None
) -> DataFrame:
    """Splits and dividends of each bar's date by one as-of join; either may be missing."""
    given = [x for x in (splits, dividends) if x is not None]
    if not given:
        return bars
    bound = given[0].select(KEY) if len(given) == 1 else splits.select(KEY).unionAll(
        dividends.select(KEY)
    )
    joined = asof_next(
        bars, merged_actions(splits, dividends), "_date", ["_split", "_dividend"],
        at=F.to_date("window_start"), bounded_by=bound,
    )
    factor = F.coalesce(F.nullif("_split", F.lit(0.0)), F.lit(1.0)) * F.coalesce(
        "_dividend", F.lit(1.0)
    )
    return _scale(joined, factor, OHLC).drop("_split", "_dividend")


def _later_product(date_col: str) -> "W":
    return (
        W.partitionBy(KEY)
        .orderBy(F.col(date_col).desc(), F.col("_unit").asc())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )


def split_factors(splits: DataFrame) -> DataFrame:
    """Cumulative factor of each split: product of 1/ratio over it and all later ones."""
    ratio = F.coalesce(F.nullif(F.col("split_ratio").cast("double"), F.lit(0.0)), F.lit(1.0))
    return (
        splits.withColumn("_unit", F.lit(1.0) / ratio)
        .withColumn(
            "historical_adjustment_factor",
            F.product("_unit").over(_later_product("execution_date")),
        )
        .drop("_unit")
    )


def previous_close(dates: DataFrame, bars: DataFrame, date_col: str) -> DataFrame:
    """Last daily close strictly before each date (as-of join, backward and strict).

    Every bar is sent to the first date after it, the last close per date is
    taken with a map-side combine, and gaps are filled from earlier dates.
    """
    wanted = dates.select(KEY, date_col).distinct()
    marked = wanted.withColumn("_next", F.col(date_col))
    bar_date = F.coalesce("session_end_date", F.to_date("window_start"))
    closes = on_track(bars, DAY).select(KEY, "window_start", "session_end_date", "close")
    last = (
        asof_next(
            closes, marked, date_col, ["_next"], at=bar_date, how="inner", bounded_by=dates
        )
        .groupBy(KEY, "_next")
        .agg(F.max_by("close", "window_start").alias("_last"))
    )
    earlier = W.partitionBy(KEY).orderBy(date_col).rowsBetween(W.unboundedPreceding, 0)
    return (
        wanted.join(last.withColumnRenamed("_next", date_col), [KEY, date_col], "left")
        .withColumn("prev_close", F.last("_last", ignorenulls=True).over(earlier))
        .drop("_last")
    )


def dividend_factors(dividends: DataFrame, bars: DataFrame) -> DataFrame:
    """Cumulative dividend factor from the close before each ex-date.

    A missing or unusable close leaves the unit at 1 but the row is still emitted.
    """
    unit = F.lit(1.0) - F.col("amount") / F.col("prev_close")
    usable = (F.col("prev_close") > 0) & (F.col("amount") > 0) & (unit > 0) & (unit <= 1)
    closes = previous_close(dividends, bars, "ex_dividend_date")
    return (
        dividends.join(closes, [KEY, "ex_dividend_date"], "left")
        .withColumn("_unit", F.when(usable, unit).otherwise(F.lit(1.0)))
        .withColumn(
            "historical_adjustment_factor",
            F.product("_unit").over(_later_product("ex_dividend_date")),
        )
        .drop("_unit", "prev_close")
    )
