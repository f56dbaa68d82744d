"""Landed vendor payloads (JSON text) to canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.instruments import instrument_key
from barloom.operators.adjust import unadjust_splits
from barloom.schema import KEY, TICKER_COLUMNS, TICKER_TYPE_COLUMNS

# Fields of the vendors' payloads.
FUTURES_BAR = (
    "ticker string, window_start string, session_end_date string, open double, high double, "
    "low double, close double, settlement_price double, volume double, transactions double, "
    "dollar_volume double"
)
V2_BAR = "t string, o double, h double, l double, c double, v double, n double, vw double"
CONTRACT = (
    "ticker string, product_code string, first_trade_date string, last_trade_date string, "
    "settlement_date string, date string, trade_tick_size double, name string, type string, "
    "active boolean"
)
SPLIT = (
    "ticker string, execution_date string, historical_adjustment_factor double, "
    "adjustment_type string, split_from bigint, split_to bigint"
)
DIVIDEND = (
    "ticker string, ex_dividend_date string, declaration_date string, record_date string, "
    "pay_date string, cash_amount double, currency string, distribution_type string, "
    "frequency bigint, historical_adjustment_factor double, id string"
)
CHART = (
    "chart struct<result: array<struct<"
    "timestamp: array<bigint>, "
    "indicators: struct<quote: array<struct<open: array<double>, high: array<double>, "
    "low: array<double>, close: array<double>, volume: array<double>>>>, "
    "events: struct<"
    "splits: map<string, struct<date: bigint, numerator: double, denominator: double, "
    "splitRatio: string>>, "
    "dividends: map<string, struct<date: bigint, amount: double>>>>>>"
)


def read_payloads(spark: SparkSession, root: str, *, whole_files: bool = False) -> DataFrame:
    """Landed JSON as column ``payload``, one per line or per file.

    What identifies a payload (product, instrument) is in its folders' names
    (``symbol=...``) and becomes columns of text.
    """
    reader = spark.read.option("wholetext", whole_files)
    rows = reader.text(root).withColumnRenamed("value", "payload")
    names = [F.col(c).cast("string").alias(c) for c in rows.columns if c != "payload"]
    return rows.select(*names, "payload")


def rejects(payloads: DataFrame, *, time: str) -> DataFrame:
    """What the bar readers leave out, with the reason and the offending text.

    ``time`` is the payloads' time field. A payload that is no JSON object with a
    list of results is one row; of the others every result without a readable
    epoch is one.
    """
    keep = [c for c in payloads.columns if c != "payload"]
    parsed = payloads.withColumn(
        "_results", F.from_json("payload", f"results array<struct<{time}: string>>")["results"]
    )
    unread = parsed.filter("_results IS NULL AND payload IS NOT NULL").select(
        *keep, F.lit("unreadable payload").alias("reason"), F.col("payload").alias("text")
    )
    empty = parsed.filter("payload IS NULL").select(
        *keep, F.lit("no payload").alias("reason"), F.lit(None).cast("string").alias("text")
    )
    epochs = parsed.select(*keep, F.inline("_results")).filter(F.col(time).try_cast("bigint").isNull())
    malformed = epochs.select(
        *keep, F.lit("malformed epoch").alias("reason"), F.col(time).alias("text")
    )
    return unread.unionByName(empty).unionByName(malformed)


def _results(payloads: DataFrame, item: str, keep: list[str]) -> DataFrame:
    """Rows of a ``{"results": [...]}`` payload held in column ``payload``."""
    parsed = F.from_json("payload", f"results array<struct<{_typed(item)}>>")
    return payloads.select(*keep, F.inline(parsed["results"]))


def _typed(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split(",")))


def _epoch(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def _day(text: str) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def futures_bars(payloads: DataFrame) -> DataFrame:
    """Futures bars: epoch nanoseconds and ISO session dates; keyed by product.

    Rows without a readable epoch are left to :func:`rejects`; numbers out of range are null.
    """
    rows = _results(payloads, FUTURES_BAR, ["product_code"])
    return rows.withColumns(
        {
            "window_start": _epoch(F.expr("try_cast(window_start AS BIGINT) DIV 1000")),
            "session_end_date": _day("session_end_date"),
            "volume": F.col("volume").try_cast("bigint"),
            "transactions": F.col("transactions").try_cast("bigint"),
            "instrument_type": F.lit("futures"),
            "symbol": F.col("product_code"),
            KEY: instrument_key(F.lit("futures"), F.col("product_code")),
        }
    ).filter("window_start IS NOT NULL")


def v2_bars(payloads: DataFrame) -> DataFrame:
    """Short-named bars of single-symbol instruments: epoch milliseconds.

    Dollar volume is volume times vwap; the session date is the UTC date. Rows
    without a readable epoch are left to :func:`rejects`.
    """
    identity = ["instrument_type", "symbol"]
    rows = _results(payloads, V2_BAR, identity)
    start = _epoch(F.try_multiply(F.col("t").try_cast("bigint"), F.lit(1000)))
    return rows.filter(start.isNotNull()).select(
        instrument_key(F.col("instrument_type"), F.col("symbol")).alias(KEY),
        *identity,
        F.lit("1min").alias("resolution"),
        start.alias("window_start"),
        F.to_date(start).alias("session_end_date"),
        F.col("symbol").alias("ticker"),
        F.col("o").alias("open"),
        F.col("h").alias("high"),
        F.col("l").alias("low"),
        F.col("c").alias("close"),
        F.col("v").try_cast("bigint").alias("volume"),
        F.col("n").try_cast("bigint").alias("transactions"),
        (F.col("v") * F.col("vw")).alias("dollar_volume"),
        F.col("vw").alias("vwap"),
    )


def _chart_result(payloads: DataFrame) -> DataFrame:
    """First chart result per payload; payloads carry their instrument."""
    parsed = F.from_json("payload", CHART)
    return payloads.select(
        KEY, "symbol", F.try_element_at(parsed["chart"]["result"], F.lit(1)).alias("r")
    )


def chart_bars(payloads: DataFrame) -> DataFrame:
    """Daily chart arrays as rows; incomplete bars are dropped, missing volume is 0."""
    quote = F.try_element_at(F.col("r.indicators.quote"), F.lit(1))
    zipped = F.arrays_zip(
        F.col("r.timestamp").alias("ts"),
        *[quote[c].alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    rows = _chart_result(payloads).select(KEY, "symbol", F.inline(zipped))
    day = F.to_date(F.timestamp_seconds("ts"))
    return rows.filter("ts IS NOT NULL").dropna(subset=["open", "high", "low", "close"]).select(
        KEY,
        F.lit("1day").alias("resolution"),
        day.cast("timestamp_ntz").alias("window_start"),
        day.alias("session_end_date"),
        F.col("symbol").alias("ticker"),
        "open",
        "high",
        "low",
        "close",
        F.coalesce(F.col("volume").try_cast("bigint"), F.lit(0)).alias("volume"),
    )


def chart_splits(payloads: DataFrame) -> DataFrame:
    """Split events: numerator / denominator, else the ``a:b`` text; ratios above 0."""
    event = F.explode(F.map_values("r.events.splits")).alias("e")
    rows = _chart_result(payloads).select(KEY, event).select(KEY, "e.*")
    parts = F.split("splitRatio", ":", 2)
    text = F.try_element_at(parts, F.lit(1)).try_cast("double") / F.nullif(
        F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(0.0)
    )
    exact = F.coalesce("numerator", F.lit(0.0)) / F.nullif(
        F.coalesce("denominator", F.lit(0.0)), F.lit(0.0)
    )
    usable = F.coalesce("denominator", F.lit(0.0)) != 0
    return (
        rows.filter("date IS NOT NULL")
        .select(
            KEY,
            F.to_date(F.timestamp_seconds("date")).alias("execution_date"),
            F.when(usable, exact).otherwise(text).alias("split_ratio"),
        )
        .filter("split_ratio > 0")
    )


def chart_dividends(payloads: DataFrame) -> DataFrame:
    """Dividend events with a date and an amount."""
    event = F.explode(F.map_values("r.events.dividends")).alias("e")
    rows = _chart_result(payloads).select(KEY, event).select(KEY, "e.*")
    return rows.filter("date IS NOT NULL AND amount IS NOT NULL").select(
        KEY, F.to_date(F.timestamp_seconds("date")).alias("ex_dividend_date"), "amount"
    )


def daily_raw_bars(payloads: DataFrame, factors: DataFrame) -> DataFrame:
    """Daily chart bars with the vendor's split adjustment taken out again."""
    return unadjust_splits(chart_bars(payloads), factors)


def contract_rows(payloads: DataFrame) -> DataFrame:
    """Contract listing rows with their four dates parsed."""
    rows = _results(payloads, CONTRACT, [])
    dates = ["first_trade_date", "last_trade_date", "settlement_date", "date"]
    return rows.withColumns({c: _day(c) for c in dates})


def vendor_splits(payloads: DataFrame) -> DataFrame:
    rows = _results(payloads, SPLIT, [])
    return rows.withColumn("execution_date", _day("execution_date")).withColumn(
        KEY, F.concat(F.lit("stocks:"), F.col("ticker"))
    )


def vendor_dividends(payloads: DataFrame) -> DataFrame:
    rows = _results(payloads, DIVIDEND, [])
    dates = ["ex_dividend_date", "declaration_date", "record_date", "pay_date"]
    return rows.withColumns({c: _day(c) for c in dates}).withColumn(
        KEY, F.concat(F.lit("stocks:"), F.col("ticker"))
    )


def ticker_rows(rows: DataFrame) -> DataFrame:
    """Listing rows with the sixteen fixed columns; textual ``active`` becomes boolean."""

    def column(name: str) -> Column:
        kind = "boolean" if name == "active" else "string"
        if name not in rows.columns:
            return F.lit(None).cast(kind).alias(name)
        if name == "active" and dict(rows.dtypes)[name] == "string":
            return F.lower(name).isin("true", "1", "yes").alias(name)
        return F.col(name).cast(kind).alias(name)

    return rows.select(*[column(c) for c in TICKER_COLUMNS])


def ticker_type_rows(rows: DataFrame) -> DataFrame:
    """Ticker-type rows with the four fixed columns."""
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c)
            for c in TICKER_TYPE_COLUMNS
        ]
    )
