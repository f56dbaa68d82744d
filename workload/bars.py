"""Registered queries over minute, contract and daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import adjust, basket, filters, merge, resample, roll, ticks
from barloom.plans.bar_query import BarQuery, query_bars, query_gate, query_quality
from barloom.session import materialize
from workload import derive as d
from workload import sql
from workload.registry import REGISTERED, query
from workload.sql import with_tables

OHLC = "open:6 high:6 low:6 close:6"
BAR = f"instrument_key window_start:s {OHLC}"
MINUTE_OUT = f"{BAR} session_end_date:s candle_count ticker volume transactions dollar_volume:2"
DAY_OUT = f"{BAR} session_end_date:s candle_count volume transactions"


def _merged(spark, sf):
    return merge.merge_runs(d.runs(spark, sf))


# Chains and actions are stored tables of their own; they are written once per query.


def _chain(spark, sf):
    return materialize(roll.roll_chain(d.contracts(spark, sf)), "chain")


def _split_factors(spark, sf):
    return materialize(adjust.split_factors(d.splits(spark, sf)), "splits")


def _dividend_factors(spark, sf, bars):
    dividends = materialize(d.dividends(spark, sf), "ex-dates")
    return materialize(adjust.dividend_factors(dividends, bars), "dividends")


# Queries that read their bars more than once start from stored bars, as a user would.


def _daily(spark, sf):
    return materialize(d.daily_bars(spark, sf), "daily-bars")


def _contract_bars(spark, sf):
    return materialize(d.contract_bars(spark, sf), "contract-bars")


def _dividend_adjusted(spark, sf):
    bars = _daily(spark, sf)
    return adjust.adjust_dividends(bars, _dividend_factors(spark, sf, bars))


def _typed_weights(spark, sf):
    """A basket per instrument type, weighted by the number of minutes traded."""
    held = d.minute_bars(spark, sf).groupBy("instrument_type", "instrument_key").agg(
        F.count("*").cast("double").alias("weight")
    )
    return held.withColumnRenamed("instrument_type", "basket")


def _adjusted_weeks(spark, sf):
    bars = _daily(spark, sf)
    return query_bars(
        bars,
        BarQuery("1week", adjust=True),
        splits=_split_factors(spark, sf),
        dividends=_dividend_factors(spark, sf, bars),
    )


# --- merge ---------------------------------------------------------------------------------

query(
    "merge_runs",
    _merged,
    f"{BAR} ticker volume transactions run_id",
    with_tables("SELECT * FROM merged", "merged"),
)
query(
    "merge_report",
    lambda s, sf: merge.merge_report(d.runs(s, sf)),
    "instrument_key resolution rows_read row_count source_run_count window_start_min:s "
    "window_start_max:s duplicates_removed",
    with_tables(
        """
        SELECT instrument_key, resolution, count(*) AS rows_read,
               count(*) FILTER (rk = 1) AS row_count,
               count(DISTINCT run_id) FILTER (rk = 1) AS source_run_count,
               min(window_start) FILTER (rk = 1) AS window_start_min,
               max(window_start) FILTER (rk = 1) AS window_start_max,
               count(*) FILTER (rk > 1) AS duplicates_removed
        FROM ranked GROUP BY 1, 2
        """,
        "ranked",
    ),
)
query(
    "integer_range_report",
    lambda s, sf: merge.integer_range_report(d.minute_bars(s, sf)),
    "instrument_key volume_min volume_max transactions_min transactions_max volume_fits_int32 "
    "transactions_fits_int32",
    with_tables(
        """
        SELECT instrument_key, min(volume) AS volume_min, max(volume) AS volume_max,
               min(transactions) AS transactions_min, max(transactions) AS transactions_max,
               max(volume) <= 2147483647 AS volume_fits_int32,
               max(transactions) <= 2147483647 AS transactions_fits_int32
        FROM mb GROUP BY 1
        """,
        "mb",
    ),
)
query(
    "stamp_identity",
    lambda s, sf: merge.stamp_identity(
        d.minute_bars(s, sf).drop("instrument_key", "instrument_type", "product_code"),
        d.instruments(s, sf),
    ),
    "instrument_key instrument_type symbol product_code window_start:s close:6",
    with_tables("SELECT *, symbol AS product_code FROM mb", "mb"),
)
query(
    "contract_history",
    lambda s, sf: merge.contract_history(d.contract_snapshots(s, sf)),
    "product_code ticker first_trade_date:s last_trade_date:s trade_tick_size:4 type date:s",
    with_tables(
        """
        SELECT * REPLACE (coalesce(trade_tick_size, usual) AS trade_tick_size)
        FROM (SELECT * FROM snaps QUALIFY row_number() OVER (
                PARTITION BY product_code, ticker ORDER BY date DESC) = 1)
        LEFT JOIN (
          SELECT product_code, mode(trade_tick_size) AS usual
          FROM (SELECT * FROM snaps QUALIFY row_number() OVER (
                  PARTITION BY product_code, ticker ORDER BY date DESC) = 1)
          WHERE ticker NOT LIKE '%-%' GROUP BY 1) USING (product_code)
        """,
        "contracts",
        extra={
            "snaps": """
            SELECT c.* REPLACE (e.day AS date,
                     CASE WHEN e.n % 2 = 0 THEN length(e.p) / 100 END AS trade_tick_size)
            FROM (SELECT upper(event_type) AS p, CAST(ts AS DATE) AS day, count(*) AS n
                  FROM events GROUP BY 1, 2) e
            JOIN (SELECT * FROM contracts UNION ALL
                  SELECT * REPLACE (ticker || '-NEXT' AS ticker, 'single' AS type)
                  FROM contracts) c
              ON c.product_code = e.p AND c.date = date_trunc('week', e.day)
            """
        },
    ),
)

# --- range, intraday, limits ----------------------------------------------------------------

query(
    "filter_range",
    lambda s, sf: filters.filter_range(d.minute_bars(s, sf), "2024-01-05 12:30", "2024-01-09"),
    f"{BAR} volume",
    with_tables(
        "SELECT * FROM mb WHERE window_start BETWEEN TIMESTAMP '2024-01-05 12:30:00'"
        " AND TIMESTAMP '2024-01-09 23:59:59.999999'",
        "mb",
    ),
)
query(
    "intraday_chicago",
    lambda s, sf: filters.filter_intraday(
        d.minute_bars(s, sf), "09:30", "16:00", "America/Chicago"
    ),
    BAR,
    with_tables(
        "SELECT * FROM mb WHERE CAST(window_start AT TIME ZONE 'UTC' AT TIME ZONE"
        " 'America/Chicago' AS TIME) BETWEEN TIME '09:30' AND TIME '16:00'",
        "mb",
    ),
)
query(
    "intraday_overnight",
    lambda s, sf: filters.filter_intraday(d.minute_bars(s, sf), "20:00", "04:00", "Asia/Tokyo"),
    BAR,
    with_tables(
        "SELECT * FROM (SELECT *, CAST(window_start AT TIME ZONE 'UTC' AT TIME ZONE"
        " 'Asia/Tokyo' AS TIME) AS t FROM mb) WHERE t >= TIME '20:00' OR t <= TIME '04:00'",
        "mb",
    ),
)
query(
    "first_bars",
    lambda s, sf: filters.first_bars(d.minute_bars(s, sf), 25),
    BAR,
    with_tables(
        "SELECT * FROM mb QUALIFY row_number() OVER (PARTITION BY instrument_key"
        " ORDER BY window_start) <= 25",
        "mb",
    ),
)
query(
    "latest_page",
    lambda s, sf: filters.chart_rows(
        filters.latest_page(d.minute_bars(s, sf), 100, before="2024-01-20", after="2024-01-03")
    ),
    "instrument_key time open:6 high:6 low:6 close:6 volume:1",
    with_tables(
        "SELECT *, epoch_ms(window_start) AS time FROM mb"
        " WHERE window_start BETWEEN TIMESTAMP '2024-01-03'"
        " AND TIMESTAMP '2024-01-20 23:59:59.999999'"
        " QUALIFY row_number() OVER (PARTITION BY instrument_key"
        " ORDER BY window_start DESC) <= 100",
        "mb",
    ),
)
query(
    "project_columns",
    lambda s, sf: filters.select_columns(
        d.minute_bars(s, sf), ["close", "window_start", "instrument_key"]
    ),
    "close:6 window_start:s instrument_key",
    with_tables("SELECT * FROM mb", "mb"),
)

# --- resampling -----------------------------------------------------------------------------

query(
    "session_bars_60m",
    lambda s, sf: resample.resample_minutes(_merged(s, sf), 60),
    MINUTE_OUT,
    with_tables(sql.minutes("merged", 60), "merged"),
)
query(
    "session_bars_7m",
    lambda s, sf: resample.resample_minutes(d.minute_bars(s, sf), 7),
    MINUTE_OUT,
    with_tables(sql.minutes("mb", 7), "mb"),
)
query(
    "intraday_bars_chicago_15m",
    lambda s, sf: query_bars(
        d.minute_bars(s, sf),
        BarQuery("15min", begin="09:30", finish="16:00", timezone="America/Chicago"),
    ),
    MINUTE_OUT,
    with_tables(
        sql.minutes("src", 15, "09:30", "16:00", "America/Chicago"),
        "mb",
        extra={
            "src": "SELECT * FROM mb WHERE CAST(window_start AT TIME ZONE 'UTC' AT TIME ZONE"
            " 'America/Chicago' AS TIME) BETWEEN TIME '09:30' AND TIME '16:00'"
        },
    ),
)
query(
    "overnight_bars_2h",
    lambda s, sf: query_bars(
        d.minute_bars(s, sf), BarQuery("2hour", begin="20:00", finish="04:00")
    ),
    MINUTE_OUT,
    with_tables(
        sql.minutes("src", 120, "20:00", "04:00"),
        "mb",
        extra={
            "src": "SELECT * FROM mb WHERE CAST(window_start AS TIME) >= TIME '20:00'"
            " OR CAST(window_start AS TIME) <= TIME '04:00'"
        },
    ),
)
query(
    "weekly_bars",
    lambda s, sf: resample.resample_days(_daily(s, sf), 7, week_aligned=True),
    DAY_OUT,
    with_tables(sql.days("db", 7, True), "db"),
)
query(
    "two_week_bars",
    lambda s, sf: resample.resample_days(_daily(s, sf), 14, week_aligned=True),
    DAY_OUT,
    with_tables(sql.days("db", 14, True), "db"),
)
query(
    "three_day_bars",
    lambda s, sf: resample.resample_days(_daily(s, sf), 3),
    DAY_OUT,
    with_tables(sql.days("db", 3), "db"),
)

#: Daily bars of the instruments of the minute track.
SESSION_DAYS = """
    SELECT instrument_key, '1day' AS resolution, session_end_date,
           CAST(session_end_date AS TIMESTAMP) AS window_start, any_value(ticker) AS ticker,
           arg_min(open, window_start) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, window_start) AS close, CAST(sum(volume) AS BIGINT) AS volume,
           CAST(sum(transactions) AS BIGINT) AS transactions
    FROM mb GROUP BY instrument_key, session_end_date
"""


def _both_tracks(spark, sf):
    return materialize(d.both_tracks(spark, sf), "both-tracks")


query(
    "resample_mixed_tracks",
    lambda s, sf: resample.resample_minutes(_both_tracks(s, sf), 30),
    f"{MINUTE_OUT} resolution",
    with_tables(f"SELECT *, '1min' AS resolution FROM ({sql.minutes('mb', 30)})", "mb"),
)
query(
    "weeks_of_mixed_tracks",
    lambda s, sf: resample.resample_days(_both_tracks(s, sf), 7, week_aligned=True),
    f"{DAY_OUT} resolution",
    with_tables(
        f"SELECT *, '1min' AS resolution FROM ({sql.days('mb', 7, True)}) UNION ALL"
        f" SELECT *, '1day' AS resolution FROM ({sql.days('session_days', 7, True)})",
        "mb",
        extra={"session_days": SESSION_DAYS},
    ),
)
query(
    "basket_mixed_tracks",
    lambda s, sf: basket.basket_bars(_both_tracks(s, sf), _typed_weights(s, sf)),
    f"{BAR} resolution volume:4",
    with_tables(
        """
        SELECT 'portfolio:' || basket AS instrument_key, resolution, window_start, volume,
               open * 100 / base AS open, high * 100 / base AS high, low * 100 / base AS low,
               close * 100 / base AS close
        FROM sums JOIN (SELECT basket, resolution, arg_min(close, window_start) AS base
                        FROM sums GROUP BY ALL HAVING count(*) >= 2) USING (basket, resolution)
        """,
        "mb",
        extra={
            "both_tracks": "SELECT instrument_key, resolution, window_start, open, high, low, close,"
            f" volume FROM mb UNION ALL SELECT instrument_key, resolution, window_start, open, high,"
            f" low, close, volume FROM ({SESSION_DAYS})",
            "legs": """
                SELECT split_part(instrument_key, ':', 1) AS basket, instrument_key,
                       count(*) / sum(count(*)) OVER kind AS weight, count(*) OVER kind AS legs
                FROM mb GROUP BY instrument_key
                WINDOW kind AS (PARTITION BY split_part(instrument_key, ':', 1))""",
            "sums": """
                SELECT basket, resolution, window_start, sum(open * weight) AS open,
                       sum(high * weight) AS high, sum(low * weight) AS low,
                       sum(close * weight) AS close, sum(volume * weight) AS volume
                FROM both_tracks JOIN legs USING (instrument_key)
                GROUP BY ALL HAVING count(*) = max(legs)""",
        },
    ),
)

# --- splits and dividends -------------------------------------------------------------------

query(
    "split_factors",
    lambda s, sf: adjust.split_factors(d.splits(s, sf)),
    "instrument_key execution_date:s split_ratio historical_adjustment_factor:10",
    with_tables("SELECT *, factor AS historical_adjustment_factor FROM sf", "sf"),
)
query(
    "previous_close",
    lambda s, sf: adjust.previous_close(
        materialize(d.dividends(s, sf), "ex-dates"), d.daily_bars(s, sf), "ex_dividend_date"
    ),
    "instrument_key ex_dividend_date:s prev_close:6",
    with_tables("SELECT * FROM prev_closes", "prev_closes"),
)
query(
    "dividend_factors",
    lambda s, sf: adjust.dividend_factors(
        materialize(d.dividends(s, sf), "ex-dates"), d.daily_bars(s, sf)
    ),
    "instrument_key ex_dividend_date:s amount historical_adjustment_factor:10",
    with_tables("SELECT *, factor AS historical_adjustment_factor FROM df", "df"),
)
query(
    "adjust_splits",
    lambda s, sf: adjust.adjust_splits(d.daily_bars(s, sf), _split_factors(s, sf)),
    f"{BAR} volume",
    with_tables(sql.asof_factor("db", "sf", "execution_date"), "db", "sf"),
)
query(
    "unadjust_splits",
    lambda s, sf: adjust.unadjust_splits(d.daily_bars(s, sf), _split_factors(s, sf)),
    "instrument_key window_start:s open:3 high:3 low:3 close:3 volume",
    with_tables(sql.asof_factor("db", "sf", "execution_date", "/"), "db", "sf"),
)
query(
    "adjust_dividends",
    _dividend_adjusted,
    f"{BAR} volume",
    with_tables(sql.asof_factor("db", "df", "ex_dividend_date"), "db", "df"),
)
query(
    "query_adjusted_weeks",
    _adjusted_weeks,
    DAY_OUT,
    with_tables(
        sql.days("adjusted", 7, True),
        "db",
        "sf",
        "df",
        extra={
            "split_adjusted": sql.asof_factor("db", "sf", "execution_date"),
            "adjusted": sql.asof_factor("split_adjusted", "df", "ex_dividend_date"),
        },
    ),
)

# --- roll chain and tick grid ---------------------------------------------------------------

query(
    "roll_chain",
    lambda s, sf: roll.roll_chain(d.contracts(s, sf)),
    "instrument_key ticker first_trade_date:s last_trade_date:s settlement_date:s "
    "rollover_date:s active_from:s active_until:s trade_tick_size:4 name roll_rank",
    with_tables("SELECT * FROM chain", "chain"),
)
query(
    "single_symbol_chain",
    lambda s, sf: roll.single_symbol_chain(d.instruments(s, sf), "2024-02-03"),
    "instrument_key ticker active_from:s active_until:s trade_tick_size:4",
    with_tables(
        "SELECT instrument_key, symbol AS ticker, DATE '1900-01-01' AS active_from,"
        " DATE '2124-02-03' AS active_until, 0.0 AS trade_tick_size FROM instruments"
        " WHERE instrument_type NOT IN ('futures', 'options')",
        "instruments",
    ),
)
query(
    "active_contract",
    lambda s, sf: roll.active_contract(
        d.minute_bars(s, sf).selectExpr("instrument_key", "session_end_date AS day").distinct(),
        _chain(s, sf),
    ),
    "instrument_key day:s active_ticker active_tick_size:4 active_last_trade_date:s",
    with_tables(
        """
        SELECT r.instrument_key, r.day,
               coalesce(
                 arg_min(c.ticker, c.roll_rank) FILTER (c.active_from <= r.day
                                                        AND r.day < c.active_until),
                 arg_max(c.ticker, c.roll_rank) FILTER (c.active_from <= r.day),
                 arg_min(c.ticker, c.roll_rank)) AS active_ticker,
               coalesce(
                 arg_min(c.trade_tick_size, c.roll_rank) FILTER (c.active_from <= r.day
                                                        AND r.day < c.active_until),
                 arg_max(c.trade_tick_size, c.roll_rank) FILTER (c.active_from <= r.day),
                 arg_min(c.trade_tick_size, c.roll_rank)) AS active_tick_size,
               coalesce(
                 arg_min(c.last_trade_date, c.roll_rank) FILTER (c.active_from <= r.day
                                                        AND r.day < c.active_until),
                 arg_max(c.last_trade_date, c.roll_rank) FILTER (c.active_from <= r.day),
                 arg_min(c.last_trade_date, c.roll_rank)) AS active_last_trade_date
        FROM (SELECT DISTINCT instrument_key, session_end_date AS day FROM mb) r
        LEFT JOIN chain c USING (instrument_key) GROUP BY 1, 2
        """,
        "mb",
        "chain",
    ),
)
query(
    "overlapping_segments",
    lambda s, sf: roll.overlapping_segments(
        d.minute_bars(s, sf).selectExpr(
            "instrument_key", "session_end_date AS start_date",
            "date_add(session_end_date, 3) AS end_date",
        ).distinct(),
        _chain(s, sf),
    ),
    "instrument_key start_date:s end_date:s ticker active_from:s active_until:s",
    with_tables(
        """
        SELECT r.*, c.ticker, c.active_from, c.active_until
        FROM (SELECT DISTINCT instrument_key, session_end_date AS start_date,
                     session_end_date + 3 AS end_date FROM mb) r
        JOIN chain c ON r.instrument_key = c.instrument_key
         AND c.active_from <= r.end_date AND c.active_until > r.start_date
        """,
        "mb",
        "chain",
    ),
)
query(
    "tick_sizes",
    lambda s, sf: roll.tick_sizes(
        d.minute_bars(s, sf).select("instrument_key", "ticker").unionByName(
            d.contract_bars(s, sf).select("instrument_key", "ticker")
        ).distinct(),
        _chain(s, sf),
    ),
    "instrument_key ticker tick_size:4",
    with_tables(
        "SELECT r.*, coalesce(c.trade_tick_size, 0) AS tick_size FROM ("
        "SELECT instrument_key, ticker FROM mb UNION SELECT instrument_key, ticker FROM cb) r"
        " LEFT JOIN chain c USING (instrument_key, ticker)",
        "cb",
    ),
)
query(
    "roll_factors",
    lambda s, sf: roll.roll_factors(d.contract_bars(s, sf), _chain(s, sf)),
    "instrument_key ticker roll_rank active_from:s roll_factor:8",
    with_tables("SELECT * FROM rolls", "rolls"),
)
query(
    "adjust_rolls",
    lambda s, sf: roll.adjust_rolls(_contract_bars(s, sf), _chain(s, sf)),
    f"{BAR} ticker volume",
    with_tables(
        "SELECT cb.* REPLACE (open * roll_factor AS open, high * roll_factor AS high,"
        " low * roll_factor AS low, close * roll_factor AS close)"
        " FROM cb JOIN rolls USING (instrument_key, ticker)",
        "rolls",
    ),
)
query(
    "dedupe_timestamps",
    lambda s, sf: roll.dedupe_timestamps(d.contract_bars(s, sf), _chain(s, sf)),
    f"{BAR} ticker volume",
    with_tables("SELECT * FROM cb_once", "cb_once"),
)
query(
    "dedupe_without_chain",
    lambda s, sf: roll.dedupe_timestamps(
        d.runs(s, sf).withColumn("ticker", d.F.concat("ticker", d.F.lit("-"), "run_id"))
    ),
    f"{BAR} ticker volume",
    with_tables(
        "SELECT * REPLACE (ticker || '-' || run_id AS ticker) FROM runs"
        " QUALIFY row_number() OVER (PARTITION BY instrument_key, window_start"
        " ORDER BY run_id DESC, ticker DESC) = 1",
        "runs",
    ),
)
query(
    "normalize_ticks",
    lambda s, sf: ticks.normalize_ticks(d.contract_bars(s, sf), _chain(s, sf)),
    "instrument_key window_start:s ticker open high low close",
    with_tables(
        "SELECT instrument_key, window_start, ticker, "
        + ", ".join(
            f"CAST(CASE WHEN trade_tick_size > 0 THEN round_even({c} / trade_tick_size, 0)"
            f" ELSE trunc({c}) END AS INTEGER) AS {c}"
            for c in ("open", "high", "low", "close")
        )
        + " FROM cb JOIN (SELECT instrument_key, ticker, trade_tick_size FROM chain)"
        " USING (instrument_key, ticker)",
        "cb",
    ),
)
query(
    "tick_quality",
    lambda s, sf: query_quality(
        d.contract_bars(s, sf), BarQuery("1min"), _chain(s, sf), trigger=0.1
    ),
    "instrument_key ticker tick_size:4 total_candles bad_candles ratio:8 status",
    with_tables(
        """
        SELECT *, CASE WHEN ratio >= 0.05 THEN 'ERREUR' WHEN ratio >= 0.01 THEN 'ATTENTION'
                       ELSE 'OK' END AS status
        FROM (
          SELECT instrument_key, ticker, CASE WHEN ticker IS NOT NULL THEN max(tick) END
                   AS tick_size, count(*) AS total_candles,
                 count(*) FILTER (bad) AS bad_candles, count(*) FILTER (bad) / count(*) AS ratio
          FROM (
            SELECT cb.instrument_key, cb.ticker, trade_tick_size AS tick,
                   greatest(
                     abs(open / trade_tick_size - round_even(open / trade_tick_size, 0)),
                     abs(high / trade_tick_size - round_even(high / trade_tick_size, 0)),
                     abs(low / trade_tick_size - round_even(low / trade_tick_size, 0)),
                     abs(close / trade_tick_size - round_even(close / trade_tick_size, 0)))
                     > 0.1::DOUBLE * trade_tick_size AS bad
            FROM cb JOIN (SELECT instrument_key, ticker, trade_tick_size FROM chain)
              USING (instrument_key, ticker)
            WHERE trade_tick_size > 0)
          GROUP BY ROLLUP (instrument_key, ticker)
          HAVING instrument_key IS NOT NULL)
        """,
        "cb",
    ),
)
query(
    "query_continuous_30m",
    lambda s, sf: query_bars(
        _contract_bars(s, sf),
        BarQuery("30min", adjust=True),
        chain=_chain(s, sf),
    ),
    f"{BAR} candle_count ticker volume",
    with_tables(
        sql.minutes("adjusted", 30),
        "rolls",
        "cb_once",
        extra={
            "adjusted": "SELECT b.* REPLACE (open * roll_factor AS open,"
            " high * roll_factor AS high, low * roll_factor AS low,"
            " close * roll_factor AS close) FROM cb_once b"
            " JOIN (SELECT instrument_key, ticker, roll_factor FROM rolls)"
            " USING (instrument_key, ticker)"
        },
    ),
)
query(
    "query_tick_bars_30m",
    lambda s, sf: query_bars(
        d.contract_bars(s, sf),
        BarQuery("30min", normalize_ticks=True),
        chain=_chain(s, sf),
    ),
    "instrument_key window_start:s open high low close candle_count",
    with_tables(
        sql.minutes("ticks", 30),
        "cb_once",
        extra={
            "ticks": "SELECT b.* REPLACE ("
            + ", ".join(
                f"CAST(CASE WHEN trade_tick_size > 0 THEN round_even({c} / trade_tick_size, 0)"
                f" ELSE trunc({c}) END AS INTEGER) AS {c}"
                for c in ("open", "high", "low", "close")
            )
            + ") FROM cb_once b JOIN (SELECT instrument_key, ticker, trade_tick_size FROM chain)"
            " USING (instrument_key, ticker)"
        },
    ),
)
query(
    "query_quality_gate",
    lambda s, sf: query_gate(d.contract_bars(s, sf), BarQuery("1min"), _chain(s, sf)),
    "instrument_key ticker bad_candles total_candles ratio:8",
    f"SELECT * FROM ({REGISTERED['tick_quality'].sql}) WHERE status = 'ERREUR' AND ticker IS NOT NULL",
)
