"""Instrument keys, vendor prefixes and market mappings as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schema import DAILY_TYPES

# Vendor ticker prefix per instrument type.
VENDOR_PREFIX = {"forex": "C:", "indices": "I:", "options": "O:"}
PREFIX_PATTERN = "(?i)^[CIO]:"

# Listing market -> instrument type (crypto is not supported).
MARKET_TYPE = {
    "stocks": "stocks",
    "otc": "stocks",
    "fx": "forex",
    "indices": "indices",
    "options": "options",
}

# Listing market -> asset class of the ticker-type table.
MARKET_ASSET_CLASS = {
    "stocks": "stocks",
    "otc": "stocks",
    "fx": "fx",
    "indices": "indices",
    "crypto": "crypto",
    "options": "options",
}

# Stock suffixes of warrants, units, rights and preferred shares.
SKIPPED_SUFFIXES = [
    ".WS", ".W", ".U", ".UN", ".R", ".RT", ".RIGHTS", ".PW", ".P",
    "-WS", "-W", "-U", "-UN", "-R", "-RT", "-P",
]


def _mapped(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def instrument_key(instrument_type: Column, symbol: Column) -> Column:
    return F.concat(instrument_type, F.lit(":"), symbol)


def vendor_ticker(instrument_type: Column, symbol: Column) -> Column:
    """Symbol with the vendor's prefix for its type."""
    return F.concat(F.coalesce(_mapped(instrument_type, VENDOR_PREFIX), F.lit("")), symbol)


def bare_ticker(ticker: Column) -> Column:
    """Ticker without its vendor prefix."""
    return F.regexp_replace(F.trim(ticker), PREFIX_PATTERN, "")


def instrument_type_of_market(market: Column) -> Column:
    return _mapped(F.lower(market), MARKET_TYPE)


def asset_class_of_market(market: Column) -> Column:
    return _mapped(F.lower(market), MARKET_ASSET_CLASS)


def is_skipped_stock(symbol: Column) -> Column:
    suffixes = "|".join(map(re.escape, SKIPPED_SUFFIXES))
    return F.upper(F.trim(symbol)).rlike(rf"({suffixes})\z")


def daily_vendor_ticker(
    instrument_type: Column, symbol: Column, override: Column | None = None
) -> Column:
    """Daily vendor's ticker; null where the symbol has none."""
    sym = F.trim(symbol)
    upper = F.upper(sym)

    def with_suffix(suffix: str) -> Column:
        return F.when(F.endswith(upper, F.lit(suffix)), upper).otherwise(
            F.concat(upper, F.lit(suffix))
        )

    mapped = (
        F.when(~instrument_type.isin(DAILY_TYPES), F.lit(None).cast("string"))
        .when(
            instrument_type == "stocks",
            F.when(~is_skipped_stock(sym), F.replace(sym, F.lit("."), F.lit("-"))),
        )
        .when(instrument_type == "forex", with_suffix("=X"))
        .when(instrument_type == "futures", with_suffix("=F"))
        .otherwise(
            F.when(F.startswith(upper, F.lit("^")), upper).otherwise(
                F.concat(F.lit("^"), upper)
            )
        )
    )
    return mapped if override is None else F.coalesce(override, mapped)
