from barloom.functions.clock import (
    bound,
    clock_seconds,
    local_seconds,
    month_horizon,
    wall_to_utc,
)
from barloom.functions.instruments import (
    asset_class_of_market,
    bare_ticker,
    daily_vendor_ticker,
    instrument_key,
    instrument_type_of_market,
    is_skipped_stock,
    vendor_ticker,
)

__all__ = [
    "asset_class_of_market",
    "bare_ticker",
    "bound",
    "clock_seconds",
    "daily_vendor_ticker",
    "instrument_key",
    "instrument_type_of_market",
    "is_skipped_stock",
    "local_seconds",
    "month_horizon",
    "vendor_ticker",
    "wall_to_utc",
]
