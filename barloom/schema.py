"""Column names, table schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "instrument_key"
MINUTE = "1min"
DAY = "1day"

OHLC = ["open", "high", "low", "close"]
PRICES = [*OHLC, "settlement_price"]
VOLUMES = ["volume", "transactions", "dollar_volume"]

BARS = T.StructType(
    [
        T.StructField("instrument_key", T.StringType()),
        T.StructField("instrument_type", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("session_end_date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("product_code", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("settlement_price", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("transactions", T.LongType()),
        T.StructField("dollar_volume", T.DoubleType()),
        T.StructField("vwap", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
    ]
)

CONTRACTS = T.StructType(
    [
        T.StructField("product_code", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("first_trade_date", T.DateType()),
        T.StructField("last_trade_date", T.DateType()),
        T.StructField("settlement_date", T.DateType()),
        T.StructField("trade_tick_size", T.DoubleType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("date", T.DateType()),
    ]
)

# The vendor's ticker listing columns, in listing order.
TICKER_COLUMNS = [
    "ticker",
    "name",
    "market",
    "locale",
    "type",
    "active",
    "primary_exchange",
    "currency_name",
    "currency_symbol",
    "base_currency_name",
    "base_currency_symbol",
    "cik",
    "composite_figi",
    "share_class_figi",
    "last_updated_utc",
    "delisted_utc",
]
TICKER_TYPE_COLUMNS = ["code", "description", "asset_class", "locale"]

# Instrument types that also have a daily track.
DAILY_TYPES = ["futures", "forex", "stocks", "indices"]

# Staleness thresholds in days per resolution, and the allowed
# gap in days between the two resolutions of one instrument.
STALE_LAG_DAYS = {MINUTE: 3, DAY: 5}
CROSS_RESOLUTION_LAG_DAYS = 7

# History horizon in months (30 days each) and re-fetch overlap.
HISTORY_MONTHS = {"futures": 24, "forex": 24, "stocks": 24, "indices": 60, "options": 24}
OVERLAP_DAYS = {MINUTE: 1, DAY: 5}
DAYS_PER_MONTH = 30

# Calendar days between a contract's roll and its expiry.
DAYS_BEFORE_EXPIRY = 7

# Share of off-grid bars that makes a ticker a warning or an error.
QUALITY_WARNING = 0.01
QUALITY_ERROR = 0.05

# Annualisation and portfolio defaults.
WEEKS_PER_YEAR = 52.0
TRADING_DAYS_PER_YEAR = 252.0
MIN_COVERAGE = 0.95
MIN_WEIGHT = 1e-6
RIDGE = 1e-10
SAMPLES = 5000
SEED = 42
FRONTIER_POINTS = 40


def track(bars: DataFrame) -> list[str]:
    """Columns that tell one series of bars from another: the instrument and its track."""
    return [c for c in (KEY, "resolution") if c in bars.columns]


def on_track(bars: DataFrame, resolution: str) -> DataFrame:
    """Bars of one track; bars without a ``resolution`` column are of one track already."""
    if "resolution" not in bars.columns:
        return bars
    return bars.filter(F.col("resolution") == resolution)
