"""Futures roll chain, continuous prices and one bar per timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.lookup import lookup_join
from barloom.schema import DAYS_BEFORE_EXPIRY, KEY, PRICES, track


def roll_chain(contracts: DataFrame, days_before_expiry: int = DAYS_BEFORE_EXPIRY) -> DataFrame:
    """Ordered segments ``[active_from, active_until)`` per product.

    Spreads (other types, or a dash in the ticker) and incomplete rows are left
    out before the previous roll date is looked up.
    """
    usable = contracts.filter(
        (F.col("type").isNull() | (F.col("type") == "single"))
        & (F.length("ticker") > 0)
        & ~F.contains("ticker", F.lit("-"))
        & F.col("first_trade_date").isNotNull()
        & F.col("last_trade_date").isNotNull()
    )
    order = W.partitionBy("product_code").orderBy("last_trade_date", "ticker")
    rolled = usable.withColumn(
        "rollover_date", F.date_sub("last_trade_date", days_before_expiry)
    )
    return rolled.select(
        F.concat(F.lit("futures:"), F.col("product_code")).alias(KEY),
        "product_code",
        "ticker",
        "first_trade_date",
        "last_trade_date",
        F.coalesce("settlement_date", "last_trade_date").alias("settlement_date"),
        "rollover_date",
        F.coalesce(F.lag("rollover_date").over(order), F.col("first_trade_date")).alias(
            "active_from"
        ),
        F.col("rollover_date").alias("active_until"),
        F.coalesce("trade_tick_size", F.lit(0.0)).alias("trade_tick_size"),
        "name",
        (F.row_number().over(order) - 1).alias("roll_rank"),
    )


def single_symbol_chain(instruments: DataFrame, today: str) -> DataFrame:
    """One open-ended segment without tick size for every instrument that never rolls."""
    start = F.lit("1900-01-01").cast("date")
    until = F.add_months(F.lit(today).cast("date"), 1200)
    return instruments.filter(~F.col("instrument_type").isin("futures", "options")).select(
        KEY,
        F.col("symbol").alias("product_code"),
        F.col("symbol").alias("ticker"),
        start.alias("first_trade_date"),
        until.alias("last_trade_date"),
        until.alias("settlement_date"),
        until.alias("rollover_date"),
        start.alias("active_from"),
        until.alias("active_until"),
        F.lit(0.0).alias("trade_tick_size"),
        F.col("symbol").alias("name"),
        F.lit(0).alias("roll_rank"),
    )


def active_contract(requests: DataFrame, chain: DataFrame, day: str = "day") -> DataFrame:
    """Contract active on each requested day.

    The containing segment, else the last one already begun, else the first.
    A product's chain travels as one sorted array, so requests are not multiplied.
    """
    segment = F.struct("roll_rank", "ticker", "active_from", "active_until", "trade_tick_size",
                       "last_trade_date")
    chains = chain.groupBy(KEY).agg(F.array_sort(F.collect_list(segment)).alias("_chain"))
    joined = lookup_join(requests, chains, [KEY], bounded_by=chain, spread_by=[KEY, day])
    on_day = F.col(day)
    holding = F.filter("_chain", lambda s: (s.active_from <= on_day) & (on_day < s.active_until))
    begun = F.filter("_chain", lambda s: s.active_from <= on_day)
    pick = F.coalesce(
        F.try_element_at(holding, F.lit(1)),
        F.try_element_at(begun, F.lit(-1)),
        F.try_element_at("_chain", F.lit(1)),
    )
    return (
        joined.withColumn("_pick", pick)
        .withColumn("active_ticker", F.col("_pick.ticker"))
        .withColumn("active_tick_size", F.col("_pick.trade_tick_size"))
        .withColumn("active_last_trade_date", F.col("_pick.last_trade_date"))
        .drop("_chain", "_pick")
    )


def overlapping_segments(requests: DataFrame, chain: DataFrame) -> DataFrame:
    """Segments that overlap each requested ``[start_date, end_date]``."""
    overlap = (F.col("active_from") <= F.col("end_date")) & (
        F.col("active_until") > F.col("start_date")
    )
    segments = chain.select(KEY, "ticker", "active_from", "active_until", "roll_rank")
    return lookup_join(requests, segments, [KEY], condition=overlap, how="inner")


def tick_sizes(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """Tick size of each row's ticker, 0 where the chain does not know it."""
    ticks = chain.groupBy(KEY, "ticker").agg(
        F.min_by("trade_tick_size", "roll_rank").alias("tick_size")
    )
    joined = lookup_join(rows, ticks, [KEY, "ticker"], bounded_by=chain)
    return joined.withColumn("tick_size", F.coalesce("tick_size", F.lit(0.0)))


def roll_factors(bars: DataFrame, chain: DataFrame) -> DataFrame:
    """Cumulative back-adjustment factor of every segment, newest segment = 1.

    One map-side combined pass finds, per contract, the first close from its
    start and the last close before its successor; the product runs over the
    handful of segments of a product.
    """
    order = W.partitionBy(KEY).orderBy("active_from", "roll_rank")
    segments = chain.select(KEY, "ticker", "active_from", "roll_rank").withColumn(
        "_next_from", F.lead("active_from").over(order)
    )
    day = F.to_date("window_start")
    priced = lookup_join(
        bars.select(KEY, "ticker", "window_start", "close"),
        segments,
        [KEY, "ticker"],
        how="inner",
        bounded_by=chain,
    )
    started, ending = day >= F.col("active_from"), day < F.col("_next_from")
    edges = priced.groupBy(KEY, "ticker", "roll_rank").agg(
        F.min_by(F.when(started, F.col("close")), F.when(started, F.col("window_start"))).alias(
            "_first"
        ),
        F.max_by(F.when(ending, F.col("close")), F.when(ending, F.col("window_start"))).alias(
            "_last"
        ),
    )
    newest_first = (
        W.partitionBy(KEY)
        .orderBy(F.col("active_from").desc(), F.col("roll_rank").desc())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ratio = F.lead("_first").over(order) / F.nullif("_last", F.lit(0.0))
    return (
        segments.join(edges, [KEY, "ticker", "roll_rank"], "left")
        .withColumn("_ratio", F.coalesce(ratio, F.lit(1.0)))
        .withColumn("roll_factor", F.product("_ratio").over(newest_first))
        .select(KEY, "ticker", "roll_rank", "active_from", "roll_factor")
    )


def adjust_rolls(bars: DataFrame, chain: DataFrame) -> DataFrame:
    """Prices of earlier contracts scaled onto the newest one; tickers are kept."""
    # a ticker that a chain lists twice keeps the factor of its newest entry
    factors = (
        roll_factors(bars, chain)
        .groupBy(KEY, "ticker")
        .agg(F.max_by("roll_factor", "roll_rank").alias("roll_factor"))
    )
    joined = lookup_join(bars, factors, [KEY, "ticker"], bounded_by=chain)
    factor = F.coalesce("roll_factor", F.lit(1.0))
    return joined.withColumns(
        {c: F.col(c) * factor for c in PRICES if c in bars.columns}
    ).drop("roll_factor")


def dedupe_timestamps(bars: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """One bar per instrument, track and timestamp: the newest contract in the chain wins.

    Without a chain (or for tickers outside it) the later run, then the later
    ticker wins, so the result does not depend on row order.
    """
    if chain is not None:
        ranks = chain.groupBy(KEY, "ticker").agg(F.max("roll_rank").alias("_roll_rank"))
        bars = lookup_join(bars, ranks, [KEY, "ticker"], bounded_by=chain)
    else:
        bars = bars.withColumn("_roll_rank", F.lit(-1))
    order = [F.coalesce("_roll_rank", F.lit(-1)).desc()]
    order += [F.col(c).desc_nulls_last() for c in ("run_id", "ticker") if c in bars.columns]
    newest = W.partitionBy("window_start", *track(bars)).orderBy(*order)
    return (
        bars.withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .drop("_rank", "_roll_rank")
    )
