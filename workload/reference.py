"""Registered queries: coverage, planning, summaries and the ticker reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import bound
from barloom.operators import coverage, filters, planning, summary, tickers
from barloom.operators.roll import roll_chain
from barloom.session import materialize, scratch_path
from barloom.sources.landing import ticker_rows
from barloom.sources.ticker_index import search_index, write_index
from workload import derive as d
from workload.registry import REGISTERED, query
from workload.sql import with_tables

TODAY = "2024-02-03"

HELD = {
    "tracks": """
        SELECT instrument_key, resolution, window_start FROM mb
        UNION ALL SELECT instrument_key, resolution, window_start FROM db
        UNION ALL SELECT DISTINCT instrument_key, '1day', CAST(session_end_date AS TIMESTAMP)
        FROM mb WHERE day(window_start) <= 20
    """,
    "cov": """
        SELECT *, lag_days > CASE resolution WHEN '1min' THEN 3 ELSE 5 END AS stale
        FROM (SELECT *, DATE '2024-02-03' - max_date AS lag_days
              FROM (SELECT instrument_key, resolution, count(*) AS rows,
                           CAST(min(window_start) AS DATE) AS min_date,
                           CAST(max(window_start) AS DATE) AS max_date
                    FROM tracks GROUP BY 1, 2))
    """,
    "issues": """
        SELECT instrument_key, CASE WHEN stale THEN 'stale' ELSE 'warn' END AS level,
               CASE WHEN stale THEN 'stale' ELSE 'missing_aggregate' END AS code,
               resolution, lag_days
        FROM grid LEFT JOIN cov USING (instrument_key, resolution)
        WHERE stale IS NULL OR stale
        UNION ALL
        SELECT instrument_key, 'warn', 'cross_resolution_lag', NULL, gap
        FROM (SELECT instrument_key,
                     abs(max(lag_days) FILTER (resolution = '1min')
                         - max(lag_days) FILTER (resolution = '1day')) AS gap
              FROM grid JOIN cov USING (instrument_key, resolution) GROUP BY 1)
        WHERE gap > 7
    """,
}
BASE = ("mb", "db", "grid")


def _held(s, sf):
    return materialize(coverage.coverage(d.all_tracks(s, sf), TODAY), "coverage")


def _issues(s, sf):
    return coverage.health_issues(d.instruments(s, sf), _held(s, sf))


def _catalog(s, sf):
    return planning.run_catalog(d.runs(s, sf))


def _chain(s, sf):
    return materialize(roll_chain(d.contracts(s, sf)), "chain")


def _listing(s, sf):
    return ticker_rows(d.tickers(s, sf))


# --- coverage and health --------------------------------------------------------------------

query(
    "coverage",
    lambda s, sf: coverage.coverage(d.all_tracks(s, sf), TODAY),
    "instrument_key resolution rows min_date:s max_date:s lag_days stale",
    with_tables("SELECT * FROM cov", *BASE, extra=HELD),
)
query(
    "expected_grid",
    lambda s, sf: coverage.expected_grid(d.instruments(s, sf)),
    "instrument_key resolution",
    with_tables("SELECT * FROM grid", "grid"),
)
query(
    "health_issues",
    _issues,
    "instrument_key level code resolution lag_days",
    with_tables("SELECT * FROM issues", *BASE, extra=HELD),
)
query(
    "instrument_health",
    lambda s, sf: coverage.instrument_health(d.instruments(s, sf), _issues(s, sf)),
    "instrument_key worst_level issue_count fails_check fails_strict_check",
    with_tables(
        """
        SELECT instrument_key,
               CASE WHEN bool_or(level = 'stale') THEN 'stale'
                    WHEN count(level) > 0 THEN 'warn' ELSE 'ok' END AS worst_level,
               count(level) AS issue_count,
               coalesce(bool_or(level = 'stale'), false) AS fails_check,
               count(level) > 0 AS fails_strict_check
        FROM instruments LEFT JOIN issues USING (instrument_key) GROUP BY 1
        """,
        *BASE,
        extra=HELD,
    ),
)
query(
    "status_table",
    lambda s, sf: coverage.status_table(
        d.instruments(s, sf), _held(s, sf), _catalog(s, sf), d.contracts(s, sf)
    ),
    "instrument_key resolution status rows min_date:s max_date:s ticker_count run_count "
    "contract_count",
    with_tables(
        """
        SELECT g.instrument_key, g.resolution,
               CASE WHEN c.rows IS NULL THEN 'missing' WHEN c.stale THEN 'stale' ELSE 'ok' END
                 AS status,
               coalesce(c.rows, 0) AS rows, c.min_date, c.max_date,
               coalesce(r.ticker_count, 0) AS ticker_count,
               coalesce(r.run_count, 0) AS run_count, coalesce(k.n, 0) AS contract_count
        FROM grid g LEFT JOIN cov c USING (instrument_key, resolution)
        LEFT JOIN (SELECT instrument_key, resolution, count(DISTINCT ticker) AS ticker_count,
                          count(*) AS run_count FROM catalog GROUP BY 1, 2) r
          USING (instrument_key, resolution)
        LEFT JOIN (SELECT 'futures:' || product_code AS instrument_key, count(*) AS n
                   FROM all_contracts GROUP BY 1) k USING (instrument_key)
        """,
        *BASE,
        "catalog",
        "all_contracts",
        extra=HELD,
    ),
)

# --- runs, plans, prerequisites -------------------------------------------------------------

query(
    "run_catalog",
    _catalog,
    "instrument_key ticker resolution run_id row_count window_start_min:s window_start_max:s",
    with_tables("SELECT * FROM catalog", "catalog"),
)
query(
    "run_overview",
    lambda s, sf: planning.run_overview(_catalog(s, sf), "2024-02-08"),
    "instrument_key resolution ticker_count run_count latest_run_date done_today",
    with_tables(
        """
        SELECT instrument_key, resolution, count(DISTINCT ticker) AS ticker_count,
               count(*) AS run_count, substr(max(run_id), 1, 8) AS latest_run_date,
               bool_or(run_id LIKE '20240208%') AS done_today
        FROM catalog GROUP BY 1, 2
        """,
        "catalog",
    ),
)
query(
    "snapshot_dates",
    lambda s, sf: planning.snapshot_dates(
        d.contracts(s, sf).select("product_code").distinct(), TODAY, interval_months=3
    ),
    "product_code snapshot_date:s",
    with_tables(
        "SELECT product_code, DATE '2024-02-03' - CAST(m * 30 AS INTEGER) AS snapshot_date"
        " FROM (SELECT DISTINCT product_code FROM contracts), range(0, 25, 3) AS r(m)",
        "contracts",
    ),
)
query(
    "futures_load_plan",
    lambda s, sf: planning.futures_load_plan(
        d.instruments(s, sf), _chain(s, sf), _held(s, sf), TODAY
    ),
    "instrument_key ticker resolution load_from:s load_to:s",
    with_tables(
        """
        SELECT instrument_key, ticker, '1min' AS resolution, load_from, load_to
        FROM (
          SELECT c.instrument_key, c.ticker,
                 greatest(least(DATE '2024-02-03' - 720,
                                coalesce(v.max_date - 1, DATE '2024-02-03' - 720)),
                          c.active_from) AS load_from,
                 least(DATE '2024-02-03', c.active_until) AS load_to
          FROM instruments i JOIN chain c USING (instrument_key)
          LEFT JOIN (SELECT * FROM cov WHERE resolution = '1min') v USING (instrument_key)
          WHERE i.instrument_type = 'futures' AND c.active_from <= DATE '2024-02-03'
            AND c.active_until > DATE '2024-02-03' - 720)
        WHERE load_from <= load_to
        """,
        *BASE,
        "chain",
        extra=HELD,
    ),
)
for _name, _resolution, _kinds, _first, _overlap in (
    ("single_load_plan_minutes", "1min", "'stocks', 'forex', 'indices'",
     "DATE '2024-02-03' - CASE instrument_type WHEN 'indices' THEN 1800 ELSE 720 END", 1),
    ("single_load_plan_days", "1day", "'stocks', 'forex', 'indices', 'futures'", "NULL", 5),
):
    query(
        _name,
        lambda s, sf, r=_resolution: planning.single_load_plan(
            d.instruments(s, sf), _held(s, sf), TODAY, r
        ),
        "instrument_key ticker resolution load_from:s load_to:s",
        with_tables(
            f"""
            SELECT instrument_key, symbol AS ticker, '{_resolution}' AS resolution,
                   coalesce(max_date - {_overlap}, {_first}) AS load_from,
                   DATE '2024-02-03' AS load_to
            FROM instruments
            LEFT JOIN (SELECT * FROM cov WHERE resolution = '{_resolution}')
              USING (instrument_key)
            WHERE instrument_type IN ({_kinds})
            """,
            *BASE,
            extra=HELD,
        ),
    )
query(
    "skip_loaded",
    lambda s, sf: planning.skip_loaded(
        planning.single_load_plan(d.instruments(s, sf), _held(s, sf), TODAY),
        _catalog(s, sf),
        "2024-02-08",
    ),
    "instrument_key ticker resolution",
    with_tables(
        """
        SELECT instrument_key, symbol AS ticker, '1min' AS resolution
        FROM instruments WHERE instrument_type IN ('stocks', 'forex', 'indices')
          AND NOT EXISTS (SELECT 1 FROM catalog c
                          WHERE c.instrument_key = instruments.instrument_key
                            AND c.ticker = symbol AND run_id LIKE '20240208%')
        """,
        "instruments",
        "catalog",
    ),
)
query(
    "prerequisites",
    lambda s, sf: planning.prerequisites(
        d.instruments(s, sf),
        contracts=d.contracts(s, sf),
        splits=d.splits(s, sf),
        dividends=d.dividends(s, sf),
        catalog=_catalog(s, sf),
        coverage=_held(s, sf),
    ),
    "instrument_key has_contracts has_splits has_dividends has_runs_1min has_runs_1day "
    "has_bars_1min has_bars_1day has_listing missing_step",
    with_tables(
        """
        SELECT *, CASE WHEN NOT has_listing THEN 'listing' WHEN NOT has_runs_1min THEN 'load'
                       WHEN NOT has_bars_1min THEN 'merge' END AS missing_step
        FROM (SELECT *, CASE instrument_type WHEN 'futures' THEN has_contracts
                             WHEN 'stocks' THEN has_splits AND has_dividends
                             ELSE true END AS has_listing
        FROM (
          SELECT *, instrument_key IN (SELECT 'futures:' || product_code FROM contracts)
                      AS has_contracts,
                 instrument_key IN (SELECT instrument_key FROM splits) AS has_splits,
                 instrument_key IN (SELECT instrument_key FROM dividends) AS has_dividends,
                 instrument_key IN (SELECT instrument_key FROM catalog) AS has_runs_1min,
                 false AS has_runs_1day,
                 instrument_key IN (SELECT instrument_key FROM cov WHERE resolution = '1min')
                      AS has_bars_1min,
                 instrument_key IN (SELECT instrument_key FROM cov WHERE resolution = '1day')
                      AS has_bars_1day
          FROM instruments))
        """,
        *BASE,
        "contracts",
        "splits",
        "dividends",
        "catalog",
        extra=HELD,
    ),
)


def _fetch_times(s, sf):
    """Last fetch per event type, in the text forms a manifest may hold."""
    last = d.table(s, sf, "events").groupBy("event_type").agg(F.max("ts").alias("ts"))
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return last.select(
        "event_type",
        F.when(F.col("event_type") == "error", "not a time")
        .when(F.col("event_type") == "view", F.concat(text, F.lit("+02:00")))
        .when(F.col("event_type") == "click", F.lit(None))
        .otherwise(text)
        .alias("last_fetched_at"),
    )


query(
    "freshness",
    lambda s, sf: planning.freshness(_fetch_times(s, sf), "2024-01-31T12:00:00", 1),
    "event_type is_fresh",
    """
    SELECT event_type, event_type NOT IN ('error', 'click')
           AND TIMESTAMP '2024-01-31 12:00:00'
               - (date_trunc('second', max(ts))
                  - CASE event_type WHEN 'view' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END)
               < INTERVAL 1 DAY AS is_fresh
    FROM events GROUP BY event_type
    """,
)

# --- requests -------------------------------------------------------------------------------

query(
    "resolve_instruments",
    lambda s, sf: filters.resolve_instruments(
        d.table(s, sf, "part").select(F.col("p_brand").alias("request"))
        .unionByName(d.table(s, sf, "events").select(F.upper("event_type").alias("request")))
        .unionByName(d.table(s, sf, "nation").select(F.col("n_name").alias("request")))
        .unionByName(d.instruments(s, sf).select(F.col("instrument_key").alias("request")))
        .distinct(),
        d.instruments(s, sf).unionByName(
            d.instruments(s, sf).filter("symbol LIKE 'Brand#1%'").selectExpr(
                "'indices' AS instrument_type", "symbol",
                "'indices:' || symbol AS instrument_key")
        ),
    ),
    "request status instrument_key",
    with_tables(
        """
        SELECT request, CASE count(k) WHEN 0 THEN 'unknown' WHEN 1 THEN 'ok'
                        ELSE 'ambiguous' END AS status,
               CASE WHEN count(k) = 1 THEN min(k) END AS instrument_key
        FROM (SELECT p_brand AS request FROM part UNION SELECT upper(event_type) FROM events
              UNION SELECT n_name FROM nation UNION SELECT instrument_key FROM instruments)
        LEFT JOIN (
          SELECT symbol AS request, instrument_key AS k FROM known
          UNION ALL SELECT instrument_key, instrument_key FROM known) USING (request)
        GROUP BY request
        """,
        "instruments",
        extra={
            "known": "SELECT instrument_key, symbol FROM instruments UNION ALL"
            " SELECT 'indices:' || symbol, symbol FROM instruments WHERE symbol LIKE 'Brand#1%'"
        },
    ),
)
query(
    "query_bounds",
    lambda s, sf: d.table(s, sf, "orders")
    .select(
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 3 == 1,
              F.date_format("o_orderdate", "yyyy-MM-dd'T'10:30:00"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'10:30:00'+02:00'"))
        .alias("text")
    )
    .distinct()
    .select("text", bound(F.col("text")).alias("begins"),
            bound(F.col("text"), is_end=True).alias("ends")),
    "text begins:s ends:s",
    """
    SELECT DISTINCT text, CASE o WHEN 0 THEN day WHEN 1 THEN day + INTERVAL '10:30:00'
                          ELSE day + INTERVAL '08:30:00' END AS begins,
           CASE o WHEN 0 THEN day + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
                  WHEN 1 THEN day + INTERVAL '10:30:00'
                  ELSE day + INTERVAL '08:30:00' END AS ends
    FROM (SELECT o_orderkey % 3 AS o, date_trunc('day', o_orderdate) AS day,
                 strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN ''
                   WHEN 1 THEN 'T10:30:00' ELSE 'T10:30:00+02:00' END AS text FROM orders)
    """,
)

# --- summaries ------------------------------------------------------------------------------

query(
    "distinct_values",
    lambda s, sf: summary.distinct_values(_listing(s, sf)),
    "column value count",
    with_tables(
        "SELECT column_name AS \"column\", value, count(*) AS count FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {c} AS value FROM tickers"
            for c in ("market", "type", "primary_exchange", "currency_name")
        )
        + ") WHERE value <> '' GROUP BY 1, 2",
        "tickers",
    ),
)
query(
    "instrument_summary",
    lambda s, sf: summary.instrument_summary(
        d.contract_bars(s, sf), _chain(s, sf), "2024-01-19"
    ),
    "instrument_key first_bar:s last_bar:s total_candles active_ticker tick_size:4",
    with_tables(
        """
        SELECT instrument_key, min(window_start) AS first_bar, max(window_start) AS last_bar,
               count(*) AS total_candles, any_value(c.ticker) AS active_ticker,
               any_value(c.trade_tick_size) AS tick_size
        FROM cb LEFT JOIN (SELECT * FROM chain WHERE active_from <= DATE '2024-01-19'
                             AND active_until > DATE '2024-01-19') c USING (instrument_key)
        GROUP BY 1
        """,
        "cb",
    ),
)
query(
    "futures_summary",
    lambda s, sf: summary.futures_summary(
        d.contract_bars(s, sf), _chain(s, sf), "2024-01-19"
    ).withColumn("tickers", F.array_join("tickers", ",")),
    "instrument_key tickers current_ticker trade_tick_size:4 last_trade_date:s "
    "days_to_maturity",
    with_tables(
        """
        SELECT instrument_key, string_agg(DISTINCT cb.ticker, ',' ORDER BY cb.ticker) AS tickers,
               any_value(c.ticker) AS current_ticker,
               any_value(c.trade_tick_size) AS trade_tick_size,
               any_value(c.last_trade_date) AS last_trade_date,
               any_value(c.last_trade_date) - DATE '2024-01-19' AS days_to_maturity
        FROM cb LEFT JOIN (SELECT * FROM chain WHERE active_from <= DATE '2024-01-19'
                             AND active_until > DATE '2024-01-19') c USING (instrument_key)
        GROUP BY 1
        """,
        "cb",
    ),
)
query(
    "window_performance",
    lambda s, sf: summary.window_performance(d.daily_bars(s, sf), "2001-10-31", 30).withColumn(
        "closes", F.array_join(F.transform("closes", lambda c: F.floor(c * 100 + 0.5001)), ",")
    ),
    "instrument_key points performance_pct:6 first_date:s last_date:s closes",
    with_tables(
        """
        SELECT instrument_key, count(*) AS points,
               CASE WHEN count(*) >= 2 THEN
                 (arg_max(close, window_start) - arg_min(close, window_start))
                 / abs(nullif(arg_min(close, window_start), 0)) * 100 END AS performance_pct,
               CASE WHEN count(*) >= 2 THEN min(window_start) END AS first_date,
               CASE WHEN count(*) >= 2 THEN max(window_start) END AS last_date,
               CASE WHEN count(*) >= 2 THEN
                 string_agg(CAST(CAST(floor(close * 100 + 0.5001) AS BIGINT) AS VARCHAR), ','
                            ORDER BY window_start) ELSE '' END AS closes
        FROM db WHERE window_start >= TIMESTAMP '2001-10-01' GROUP BY 1
        """,
        "db",
    ),
)

# --- ticker reference -----------------------------------------------------------------------

query(
    "search_by_text",
    lambda s, sf: tickers.search_tickers(
        _listing(s, sf), query=" RED ", markets=["Stocks", "otc"], active=True
    ),
    "ticker name market type active",
    with_tables(
        "SELECT * FROM tickers WHERE (lower(ticker) LIKE '%red%' OR lower(name) LIKE '%red%')"
        " AND market IN ('stocks', 'otc') AND active",
        "tickers",
    ),
)


def _ticker_index(s, sf):
    root = scratch_path(s, "ticker-index")
    write_index(_listing(s, sf), root)
    return root


query(
    "search_with_index",
    lambda s, sf: search_index(
        s, _ticker_index(s, sf), query=" RED ", markets=["Stocks", "otc"], active=True
    ),
    "ticker name market type active",
    REGISTERED["search_by_text"].sql,
)
query(
    "search_by_type",
    lambda s, sf: tickers.search_tickers(
        _listing(s, sf), ticker_type="promo", exchange="xnas", limit=40
    ),
    "ticker name market type active",
    with_tables(
        "SELECT * FROM tickers WHERE upper(type) = 'PROMO' AND primary_exchange = 'XNAS'"
        " ORDER BY ticker LIMIT 40",
        "tickers",
    ),
)
query(
    "search_exact",
    lambda s, sf: tickers.search_tickers(_listing(s, sf), ticker="c:b12x5"),
    "ticker name market",
    with_tables("SELECT * FROM tickers WHERE upper(ticker) = 'B12X5'", "tickers"),
)
query(
    "describe_types",
    lambda s, sf: tickers.describe_types(_listing(s, sf), d.ticker_types(s, sf)),
    "ticker market type type_description type_locale",
    with_tables(
        """
        SELECT ticker, market, type, description AS type_description, y.locale AS type_locale
        FROM tickers t LEFT JOIN ticker_types y ON t.type = y.code
         AND y.asset_class = CASE market WHEN 'otc' THEN 'stocks' ELSE market END
        """,
        "tickers",
        "ticker_types",
    ),
)
query(
    "tickers_to_instruments",
    lambda s, sf: tickers.to_instruments(_listing(s, sf)),
    "instrument_key instrument_type symbol",
    with_tables(
        """
        SELECT DISTINCT ty || ':' || sym AS instrument_key, ty AS instrument_type, sym AS symbol
        FROM (SELECT CASE market WHEN 'otc' THEN 'stocks' WHEN 'fx' THEN 'forex'
                          WHEN 'crypto' THEN NULL ELSE market END AS ty,
                     regexp_replace(ticker, '^[CIO]:', '') AS sym FROM tickers)
        WHERE ty IS NOT NULL
        """,
        "tickers",
    ),
)
query(
    "vendor_symbols",
    lambda s, sf: tickers.vendor_symbols(
        tickers.to_instruments(_listing(s, sf)),
        d.table(s, sf, "part").select(
            F.concat(F.regexp_replace("p_brand", "Brand#", "B"), F.lit("X"), "p_partkey",
                     F.lit(".WS")).alias("name"),
            F.concat("p_type", F.lit("-"), "p_partkey").alias("daily_ticker"),
            "p_size",
        ).filter("p_size > 40"),
    ),
    "instrument_key vendor_ticker daily_ticker",
    with_tables(
        """
        SELECT instrument_key,
               CASE instrument_type WHEN 'forex' THEN 'C:' WHEN 'indices' THEN 'I:'
                    WHEN 'options' THEN 'O:' ELSE '' END || symbol AS vendor_ticker,
               coalesce(o.daily, CASE instrument_type
                 WHEN 'stocks' THEN CASE WHEN symbol NOT LIKE '%.WS'
                                         THEN replace(symbol, '.', '-') END
                 WHEN 'forex' THEN symbol || '=X' WHEN 'indices' THEN '^' || symbol END)
                 AS daily_ticker
        FROM (
          SELECT DISTINCT ty || ':' || sym AS instrument_key, ty AS instrument_type,
                          sym AS symbol
          FROM (SELECT CASE market WHEN 'otc' THEN 'stocks' WHEN 'fx' THEN 'forex'
                            WHEN 'crypto' THEN NULL ELSE market END AS ty,
                       regexp_replace(ticker, '^[CIO]:', '') AS sym FROM tickers)
          WHERE ty IS NOT NULL) i
        LEFT JOIN (SELECT replace(p_brand, 'Brand#', 'B') || 'X' || p_partkey || '.WS' AS name,
                          p_type || '-' || p_partkey AS daily
                   FROM part WHERE p_size > 40) o ON o.name = i.symbol
        """,
        "tickers",
    ),
)
query(
    "display_names",
    lambda s, sf: tickers.display_names(
        tickers.to_instruments(_listing(s, sf)).unionByName(d.instruments(s, sf)),
        _listing(s, sf),
        d.contracts(s, sf),
    ),
    "instrument_key name",
    with_tables(
        """
        SELECT i.instrument_key,
               CASE WHEN i.instrument_type = 'futures' THEN i.symbol || ' Future'
                    ELSE coalesce(n.name, i.symbol) END AS name
        FROM (
          SELECT ty || ':' || sym AS instrument_key, ty AS instrument_type, sym AS symbol
          FROM own WHERE ty IS NOT NULL
          UNION ALL SELECT * FROM instruments) i
        LEFT JOIN (SELECT ty, upper(sym) AS s, arg_min(name, (market, ticker)) AS name FROM own
                   WHERE active AND name <> '' AND ty IS NOT NULL GROUP BY 1, 2) n
          ON n.s = upper(i.symbol) AND n.ty = i.instrument_type
        """,
        "tickers",
        "instruments",
        extra={
            "own": """SELECT *, CASE market WHEN 'otc' THEN 'stocks' WHEN 'fx' THEN 'forex'
                             WHEN 'crypto' THEN NULL ELSE market END AS ty,
                             regexp_replace(ticker, '^[CIO]:', '') AS sym FROM tickers"""
        },
    ),
)
query(
    "active_contracts",
    lambda s, sf: tickers.active_contracts(d.contracts(s, sf)),
    "product_code ticker active",
    with_tables("SELECT * FROM all_contracts WHERE active", "all_contracts"),
)
query(
    "dashboard_cards",
    lambda s, sf: summary.dashboard_cards(
        d.instruments(s, sf),
        tickers.display_names(d.instruments(s, sf), _listing(s, sf), d.contracts(s, sf)),
        d.daily_bars(s, sf),
        "2001-10-31",
        365,
    ),
    "instrument_key instrument_type symbol name performance_pct:6 has_1day first_date:s "
    "last_date:s",
    with_tables(
        """
        SELECT i.*, CASE WHEN instrument_type = 'futures' THEN symbol || ' Future'
                         ELSE symbol END AS name,
               coalesce(n >= 2, false) AS has_1day,
               CASE WHEN n >= 2 THEN (b - a) / abs(nullif(a, 0)) * 100 END AS performance_pct,
               CASE WHEN n >= 2 THEN f END AS first_date,
               CASE WHEN n >= 2 THEN l END AS last_date
        FROM instruments i LEFT JOIN (
          SELECT instrument_key, count(*) AS n, arg_min(close, window_start) AS a,
                 arg_max(close, window_start) AS b, min(window_start) AS f,
                 max(window_start) AS l
          FROM db WHERE window_start >= TIMESTAMP '2000-10-31' GROUP BY 1)
          USING (instrument_key)
        """,
        "instruments",
        "db",
    ),
)
