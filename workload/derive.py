"""Bar, contract, action, ticker and run tables derived from the test tables.

Everything is computed by Spark from whole tables. ``workload/sql.py`` states
the same definitions for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import instrument_key


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _event_type_of_instrument() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "forex").when(kind == "error", "indices").otherwise("futures")
    )


def minute_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Minute bars per event type; opens and closes follow the arrival order."""
    symbol = F.upper("event_type")
    ticks = table(spark, sf, "events").select(
        _event_type_of_instrument().alias("instrument_type"),
        symbol.alias("symbol"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("window_start"),
        "event_id",
        "value",
    )
    return (
        ticks.groupBy("instrument_type", "symbol", "window_start")
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.sum(F.floor(F.col("value") * 100)).alias("volume"),
            F.count("*").alias("transactions"),
        )
        .select(
            instrument_key(F.col("instrument_type"), F.col("symbol")).alias("instrument_key"),
            "instrument_type",
            "symbol",
            F.lit("1min").alias("resolution"),
            "window_start",
            F.to_date("window_start").alias("session_end_date"),
            F.col("symbol").alias("ticker"),
            F.col("symbol").alias("product_code"),
            *["open", "high", "low", "close", "volume", "transactions"],
            (F.col("close") * F.col("volume")).alias("dollar_volume"),
        )
    )


def daily_bars(spark: SparkSession, sf: str, by: str = "p_brand") -> DataFrame:
    """Daily bars of unit prices per brand (or per line number)."""
    lines = table(spark, sf, "lineitem")
    if by.startswith("p_"):
        parts = table(spark, sf, "part").select("p_partkey", by)
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
    # A number rather than a struct: fixed-width buffers keep the aggregation hash-based.
    arrival = F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e6
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        lines.groupBy(F.col(by).cast("string").alias("symbol"), "l_shipdate")
        .agg(
            F.min_by(price, arrival).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, arrival).alias("close"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
            F.count("*").alias("transactions"),
        )
        .select(
            F.concat(F.lit("stocks:"), F.col("symbol")).alias("instrument_key"),
            F.lit("stocks").alias("instrument_type"),
            "symbol",
            F.lit("1day").alias("resolution"),
            F.col("l_shipdate").alias("window_start"),
            F.to_date("l_shipdate").alias("session_end_date"),
            F.col("symbol").alias("ticker"),
            F.col("symbol").alias("product_code"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            "transactions",
        )
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping loads: all minute bars, then every third minute again, corrected."""
    bars = minute_bars(spark, sf)
    again = bars.filter(F.minute("window_start") % 3 == 0)
    return bars.withColumn("run_id", F.lit("20240201T000000")).unionByName(
        again.withColumn("close", F.col("close") + 1).withColumn(
            "run_id", F.lit("20240208T000000")
        )
    )


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly contracts per event type, one per week with data, plus their spreads."""
    weeks = (
        table(spark, sf, "events")
        .select(F.upper("event_type").alias("product_code"), F.to_date("ts").alias("d"),
                "event_id")
        .groupBy("product_code", F.trunc("d", "week").cast("date").alias("week"))
        .agg(F.count("*").alias("n"))
    )
    ticker = F.concat("product_code", F.date_format("week", "yyMMdd"))
    tick = (
        F.when(F.col("product_code") == "CLICK", 0.01)
        .when(F.col("product_code") == "VIEW", 0.05)
        .when(F.col("product_code") == "PURCHASE", 0.25)
    )
    outright = weeks.select(
        "product_code",
        ticker.alias("ticker"),
        F.date_sub("week", 30).alias("first_trade_date"),
        F.date_add("week", 11).alias("last_trade_date"),
        F.date_add("week", 12).alias("settlement_date"),
        tick.alias("trade_tick_size"),
        F.concat(ticker, F.lit(" Future")).alias("name"),
        F.when(F.col("n") % 2 == 0, "single").alias("type"),
        (F.col("n") % 2 == 0).alias("active"),
        F.col("week").alias("date"),
    )
    spreads = outright.withColumn("ticker", F.concat("ticker", F.lit("-NEXT"))).withColumn(
        "type", F.lit("single")
    )
    return outright.unionByName(spreads)


def contract_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Minute bars under their contract's ticker; on a roll day under both contracts.

    The later contract trades 1 % higher, so that the roll leaves a gap.
    """
    from barloom.operators.roll import roll_chain

    bars = minute_bars(spark, sf).filter("instrument_type = 'futures'").drop("ticker")
    chain = roll_chain(contracts(spark, sf)).select(
        F.col("instrument_key").alias("_k"), "ticker", "active_from", "active_until", "roll_rank"
    )
    held = (
        (F.col("instrument_key") == F.col("_k"))
        & (F.col("session_end_date") >= F.col("active_from"))
        & (F.col("session_end_date") <= F.col("active_until"))
    )
    lift = 1 + F.col("roll_rank") / 100
    return (
        bars.join(chain, held)
        .withColumns({c: F.col(c) * lift for c in ("open", "high", "low", "close")})
        .drop("_k", "active_from", "active_until", "roll_rank")
    )


def _lines(spark: SparkSession, sf: str, by: str) -> DataFrame:
    """Line items with the instrument key of a part column or of their own column."""
    lines = table(spark, sf, "lineitem")
    if by.startswith("p_"):
        parts = table(spark, sf, "part").select("p_partkey", by)
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return lines.withColumn("instrument_key", F.concat(F.lit("stocks:"), F.col(by)))


def splits(spark: SparkSession, sf: str, by: str = "p_brand") -> DataFrame:
    """One split per symbol and year: on its last day, ratio from the number of lines."""
    return (
        _lines(spark, sf, by)
        .groupBy("instrument_key", F.year("l_shipdate").alias("year"))
        .agg(F.max(F.to_date("l_shipdate")).alias("execution_date"), F.count("*").alias("n"))
        .select(
            "instrument_key",
            "execution_date",
            (F.lit(1) + F.col("n") % 3).cast("double").alias("split_ratio"),
        )
    )


def dividends(spark: SparkSession, sf: str, by: str = "p_brand") -> DataFrame:
    """One dividend per symbol and quarter: on its first day, amount from the quantities."""
    return (
        _lines(spark, sf, by)
        .groupBy("instrument_key", F.date_trunc("quarter", "l_shipdate").alias("quarter"))
        .agg(
            F.min(F.to_date("l_shipdate")).alias("ex_dividend_date"),
            F.max("l_quantity").alias("amount"),
        )
        .drop("quarter")
    )


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Event types, brands and, as options, part types."""
    events = table(spark, sf, "events").select(
        _event_type_of_instrument().alias("instrument_type"),
        F.upper("event_type").alias("symbol"),
    )
    parts = table(spark, sf, "part")
    brands = parts.select(F.lit("stocks").alias("instrument_type"),
                          F.col("p_brand").alias("symbol"))
    types = parts.select(F.lit("options").alias("instrument_type"),
                         F.col("p_type").alias("symbol"))
    return (
        events.unionByName(brands)
        .unionByName(types)
        .distinct()
        .withColumn("instrument_key", instrument_key(F.col("instrument_type"), F.col("symbol")))
    )


def tickers(spark: SparkSession, sf: str) -> DataFrame:
    """One listed ticker per part, spread over the vendor's markets."""
    key = F.col("p_partkey")
    market = (
        F.when(key % 7 == 0, "fx").when(key % 7 == 1, "indices").when(key % 7 == 2, "otc")
        .when(key % 7 == 3, "crypto").when(key % 7 == 4, "options").otherwise("stocks")
    )
    prefix = (
        F.when(key % 7 == 0, "C:").when(key % 7 == 1, "I:").when(key % 7 == 4, "O:").otherwise("")
    )
    suffix = F.when(key % 11 == 0, ".WS").when(key % 11 == 1, ".A").otherwise("")
    return table(spark, sf, "part").select(
        F.concat(prefix, F.regexp_replace("p_brand", "Brand#", "B"), F.lit("X"), key, suffix)
        .alias("ticker"),
        F.col("p_name").alias("name"),
        market.alias("market"),
        F.when(key % 2 == 0, "us").otherwise("global").alias("locale"),
        F.col("p_type").alias("type"),
        F.when(key % 5 == 0, "False").when(key % 5 == 1, "YES").otherwise("true").alias("active"),
        F.when(key % 3 == 0, "XNAS").when(key % 3 == 1, "XNYS").alias("primary_exchange"),
        F.when(key % 4 == 0, "").otherwise("usd").alias("currency_name"),
    )


def ticker_types(spark: SparkSession, sf: str) -> DataFrame:
    """Type descriptions per part type and asset class, from the parts listed."""
    parts = table(spark, sf, "part")
    classes = F.array(*[F.lit(c) for c in ("stocks", "FX", "indices")])
    return (
        parts.groupBy("p_type")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("p_type").alias("code"),
            F.concat(F.col("p_type"), F.lit(" x "), F.col("n")).alias("description"),
            F.explode(classes).alias("asset_class"),
            F.lit("us").alias("locale"),
        )
    )


def daily_from_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """A daily track for the event types that stopped on the 20th."""
    bars = minute_bars(spark, sf).filter(F.dayofmonth("window_start") <= 20)
    return bars.groupBy("instrument_key", F.to_date("window_start").alias("d")).agg(
        F.count("*").alias("n")
    ).select(
        "instrument_key",
        F.lit("1day").alias("resolution"),
        F.col("d").cast("timestamp_ntz").alias("window_start"),
    )


def both_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Minute bars and, under the same keys, one bar of the daily track per session."""
    minutes = minute_bars(spark, sf)
    names = ["instrument_key", "instrument_type", "symbol", "session_end_date", "ticker"]
    days = minutes.groupBy(*names).agg(
        F.min_by("open", "window_start").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "window_start").alias("close"),
        *[F.sum(c).alias(c) for c in ("volume", "transactions", "dollar_volume")],
    )
    midnight = F.col("session_end_date").cast("timestamp_ntz")
    return minutes.unionByName(
        days.withColumns(
            {"resolution": F.lit("1day"), "window_start": midnight, "product_code": F.col("symbol")}
        )
    )


def all_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, resolutions and times of every bar held."""
    columns = ["instrument_key", "resolution", "window_start"]
    return (
        minute_bars(spark, sf)
        .select(*columns)
        .unionByName(daily_bars(spark, sf).select(*columns))
        .unionByName(daily_from_minutes(spark, sf))
    )


def contract_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Contract listings of every day with data; every other one lacks the tick size."""
    days = (
        table(spark, sf, "events")
        .select(F.upper("event_type").alias("product_code"), F.to_date("ts").alias("date"))
        .groupBy("product_code", "date")
        .agg(F.count("*").alias("n"))
        .withColumn("week", F.trunc("date", "week").cast("date"))
    )
    listed = contracts(spark, sf).drop("date", "trade_tick_size")
    tick = F.when(F.col("n") % 2 == 0, F.length("product_code") / 100)
    return (
        days.join(listed.withColumnRenamed("product_code", "_p"),
                  (F.col("product_code") == F.col("_p"))
                  & (F.date_sub("last_trade_date", 11) == F.col("week")))
        .withColumn("trade_tick_size", tick)
        .drop("_p", "n", "week")
    )


def universes(spark: SparkSession, sf: str, by: str = "p_brand") -> DataFrame:
    """All brands (or line numbers) as one universe, and one universe per part of them."""
    if by == "p_brand":
        symbols = table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    else:
        symbols = table(spark, sf, "lineitem").select(
            F.col(by).cast("string").alias("symbol")
        ).distinct()
    key = F.concat(F.lit("stocks:"), F.col("symbol")).alias("instrument_key")
    half = F.concat(F.lit("half-"), (F.length("symbol") + F.ascii(F.right("symbol", F.lit(1)))) % 2)
    whole = symbols.select(F.lit("all").alias("universe"), key, "symbol")
    return whole.unionByName(symbols.select(half.alias("universe"), key, "symbol"))


#: Half a second more on every third order, so that some times have a fraction.
FRACTION = "make_dt_interval(0, 0, 0, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END)"


def overlay_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Backtests, transactions and orders from the orders table, one backtest per priority."""
    orders = table(spark, sf, "orders")
    backtest = F.concat(F.lit("bt-"), F.substring("o_orderpriority", 1, 1))
    side = F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy")
    transactions = orders.select(
        backtest.alias("backtest_id"),
        (F.col("o_orderdate") + F.expr(FRACTION)).alias("time"),
        F.col("o_totalprice").alias("price"),
        side.alias("side"),
        F.col("o_orderstatus").alias("kind"),
    )
    placed = orders.select(
        backtest.alias("backtest_id"),
        F.col("o_orderdate").alias("time_from"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("time_to"),
        F.col("o_totalprice").alias("price"),
        side.alias("side"),
        F.lit("limit").alias("order_type"),
    )
    month = F.date_format("o_orderdate", "yyyy-MM")
    entries = orders.select(
        F.concat(F.lit("run-"), month).alias("stem"),
        F.col("o_orderkey").alias("position"),
        backtest.alias("backtest_id"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(
            F.concat(F.lit("stocks:"), F.col("o_orderstatus"))
        ).alias("instrument"),
    )
    # a file without entries for every year
    empty = orders.select(F.concat(F.lit("empty-"), F.year("o_orderdate")).alias("stem")).distinct()
    backtests = entries.unionByName(empty, allowMissingColumns=True)
    return backtests, transactions, placed
