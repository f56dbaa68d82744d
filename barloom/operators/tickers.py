"""Ticker reference: search, type descriptions, instrument mapping, display names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.instruments import (
    PREFIX_PATTERN,
    asset_class_of_market,
    bare_ticker,
    daily_vendor_ticker,
    instrument_key,
    instrument_type_of_market,
    vendor_ticker,
)
from barloom.operators.lookup import lookup_join
from barloom.schema import KEY


def search_tickers(
    tickers: DataFrame,
    *,
    query: str | None = None,
    ticker: str | None = None,
    markets: list[str] | None = None,
    ticker_type: str | None = None,
    exchange: str | None = None,
    active: bool | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter the listing; the vendor prefix is removed from the argument only."""
    out = tickers
    if ticker is not None:
        out = out.filter(F.upper("ticker") == re.sub(PREFIX_PATTERN, "", ticker.strip()).upper())
    if query is not None and query.strip():
        text = F.lit(query.strip().lower())
        in_name = F.contains(F.lower(F.coalesce("name", F.lit(""))), text)
        out = out.filter(F.contains(F.lower("ticker"), text) | in_name)
    if markets:
        out = out.filter(F.lower("market").isin([m.lower() for m in markets]))
    if ticker_type is not None:
        out = out.filter(F.upper("type") == ticker_type.upper())
    if exchange is not None:
        out = out.filter(F.upper(F.coalesce("primary_exchange", F.lit(""))) == exchange.upper())
    if active is not None:
        out = out.filter(F.col("active") == active)
    out = out.orderBy("ticker")
    return out.limit(limit) if limit is not None and limit > 0 else out


def describe_types(tickers: DataFrame, types: DataFrame) -> DataFrame:
    """Add the type's description and locale, matched on code and asset class."""
    lower = F.lower("asset_class")
    first = (
        types.groupBy(F.col("code").alias("_type"), lower.alias("_asset"))
        .agg(F.min(F.struct("description", "locale")).alias("_d"))
        .select(
            "_type",
            "_asset",
            F.col("_d.description").alias("type_description"),
            F.col("_d.locale").alias("type_locale"),
        )
    )
    keyed = tickers.withColumns(
        {"_type": F.col("type"), "_asset": asset_class_of_market(F.col("market"))}
    )
    return lookup_join(keyed, first, ["_type", "_asset"], bounded_by=types).drop("_type", "_asset")


def to_instruments(tickers: DataFrame) -> DataFrame:
    """Listing rows as instruments; unsupported markets are dropped, duplicates folded."""
    return (
        tickers.select(
            instrument_type_of_market(F.col("market")).alias("instrument_type"),
            bare_ticker(F.col("ticker")).alias("symbol"),
        )
        .filter("instrument_type IS NOT NULL AND symbol <> ''")
        .distinct()
        .withColumn(KEY, instrument_key(F.col("instrument_type"), F.col("symbol")))
    )


def vendor_symbols(instruments: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Each instrument's ticker at both vendors; null where the daily one has none.

    Overrides ``(name, daily_ticker)`` are looked up by symbol first, then by key.
    """
    override = None
    if overrides is not None:
        for i, column in enumerate(("symbol", KEY)):
            named = overrides.select(
                F.col("name").alias(column), F.col("daily_ticker").alias(f"_o{i}")
            )
            instruments = lookup_join(instruments, named, [column], bounded_by=overrides)
        override = F.coalesce("_o0", "_o1")
    kind, symbol = F.col("instrument_type"), F.col("symbol")
    return (
        instruments.withColumn("vendor_ticker", vendor_ticker(kind, symbol))
        .withColumn("daily_ticker", daily_vendor_ticker(kind, symbol, override))
        .drop("_o0", "_o1")
    )


def display_names(
    instruments: DataFrame,
    tickers: DataFrame,
    contracts: DataFrame,
    *,
    any_market_for_futures: bool = True,
) -> DataFrame:
    """Readable name per instrument.

    The first named active listing row whose market belongs to the instrument's
    type. Futures have no market of their own: any named row serves (switch off
    with ``any_market_for_futures``), else "SYM Future" when the contracts are
    named so, else "SYM Continuous" when contracts are known. Otherwise the symbol.
    """
    named = tickers.filter(F.col("active") & (F.length("name") > 0)).select(
        F.upper(bare_ticker(F.col("ticker"))).alias("_symbol"),
        instrument_type_of_market(F.col("market")).alias("_type"),
        F.struct("market", "ticker").alias("_order"),
        F.col("name").alias("_name"),
    )
    by_type = (
        named.filter("_type IS NOT NULL")
        .groupBy("_symbol", "_type")
        .agg(F.min_by("_name", "_order").alias("_own_name"))
    )
    by_symbol = named.groupBy("_symbol").agg(F.min_by("_name", "_order").alias("_any_name"))
    futures = contracts.groupBy(F.col("product_code").alias("_product")).agg(
        F.bool_or(
            F.endswith("name", F.lit(" Future")) & (F.upper("name") != F.upper("product_code"))
        ).alias("_has_future")
    )
    is_future = F.col("instrument_type") == "futures"
    borrowed = F.col("_any_name") if any_market_for_futures else F.lit(None).cast("string")
    fallback = (
        F.when(F.col("_has_future"), F.concat("symbol", F.lit(" Future")))
        .when(F.col("_product").isNotNull(), F.concat("symbol", F.lit(" Continuous")))
        .otherwise(F.col("symbol"))
    )
    chosen = F.when(
        is_future,
        F.coalesce(F.nullif(borrowed, F.col("symbol")), fallback),
    ).otherwise(F.coalesce("_own_name", "symbol"))
    left = instruments.withColumn("_upper", F.upper("symbol"))
    return (
        left.join(
            by_type,
            (F.col("_upper") == F.col("_symbol")) & (F.col("instrument_type") == F.col("_type")),
            "left",
        )
        .drop("_symbol", "_type")
        .join(by_symbol, F.col("_upper") == F.col("_symbol"), "left")
        .join(futures, is_future & (F.col("symbol") == F.col("_product")), "left")
        .select(KEY, chosen.alias("name"))
    )


def active_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts still listed as active."""
    return contracts.filter("active")


