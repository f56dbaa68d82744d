"""SQL twins of ``workload/derive.py`` and building blocks of the oracle queries."""

from __future__ import annotations

# name -> (names it needs, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "mb": (
        [],
        """
        SELECT ty || ':' || sym AS instrument_key, ty AS instrument_type, sym AS symbol,
               '1min' AS resolution, window_start,
               CAST(window_start AS DATE) AS session_end_date, sym AS ticker,
               open, high, low, close, volume, transactions, close * volume AS dollar_volume
        FROM (
          SELECT CASE event_type WHEN 'signup' THEN 'forex' WHEN 'error' THEN 'indices'
                      ELSE 'futures' END AS ty,
                 upper(event_type) AS sym, date_trunc('minute', ts) AS window_start,
                 arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
                 arg_max(value, event_id) AS close,
                 CAST(sum(floor(value * 100)) AS BIGINT) AS volume, count(*) AS transactions
          FROM events GROUP BY 1, 2, 3)
        """,
    ),
    "runs": (
        ["mb"],
        """
        SELECT *, '20240201T000000' AS run_id FROM mb
        UNION ALL
        SELECT * REPLACE (close + 1 AS close), '20240208T000000' AS run_id
        FROM mb WHERE minute(window_start) % 3 = 0
        """,
    ),
    "ranked": (
        ["runs"],
        """
        SELECT *, row_number() OVER (
                 PARTITION BY instrument_key, resolution, window_start, ticker
                 ORDER BY run_id DESC) AS rk
        FROM runs
        """,
    ),
    "merged": (["ranked"], "SELECT * EXCLUDE (rk) FROM ranked WHERE rk = 1"),
    "contracts": (
        [],
        """
        SELECT * FROM (
          SELECT product_code, product_code || strftime(week, '%y%m%d') AS ticker,
                 CAST(week - INTERVAL 30 DAY AS DATE) AS first_trade_date,
                 CAST(week + INTERVAL 11 DAY AS DATE) AS last_trade_date,
                 CAST(week + INTERVAL 12 DAY AS DATE) AS settlement_date,
                 CASE product_code WHEN 'CLICK' THEN 0.01::DOUBLE WHEN 'VIEW' THEN 0.05::DOUBLE
                      WHEN 'PURCHASE' THEN 0.25::DOUBLE END AS trade_tick_size,
                 product_code || strftime(week, '%y%m%d') || ' Future' AS name,
                 CASE WHEN n % 2 = 0 THEN 'single' END AS type, n % 2 = 0 AS active,
                 CAST(week AS DATE) AS date
          FROM (SELECT upper(event_type) AS product_code, date_trunc('week', ts) AS week,
                       count(*) AS n FROM events GROUP BY 1, 2))
        """,
    ),
    "all_contracts": (
        ["contracts"],
        """
        SELECT * FROM contracts UNION ALL
        SELECT * REPLACE (ticker || '-NEXT' AS ticker, 'single' AS type) FROM contracts
        """,
    ),
    "chain": (
        ["contracts"],
        """
        SELECT 'futures:' || product_code AS instrument_key, product_code, ticker,
               first_trade_date, last_trade_date, settlement_date, rollover_date,
               coalesce(lag(rollover_date) OVER w, first_trade_date) AS active_from,
               rollover_date AS active_until,
               coalesce(trade_tick_size, 0.0) AS trade_tick_size, name,
               row_number() OVER w - 1 AS roll_rank
        FROM (SELECT *, CAST(last_trade_date - INTERVAL 7 DAY AS DATE) AS rollover_date
              FROM contracts)
        WINDOW w AS (PARTITION BY product_code ORDER BY last_trade_date, ticker)
        """,
    ),
    "cb": (
        ["mb", "chain"],
        """
        SELECT m.* REPLACE (c.ticker AS ticker,
                 m.open * (1 + c.roll_rank / 100) AS open,
                 m.high * (1 + c.roll_rank / 100) AS high,
                 m.low * (1 + c.roll_rank / 100) AS low,
                 m.close * (1 + c.roll_rank / 100) AS close),
               c.roll_rank, c.active_from
        FROM mb m JOIN chain c ON m.instrument_key = c.instrument_key
         AND m.session_end_date >= c.active_from AND m.session_end_date <= c.active_until
        WHERE m.instrument_type = 'futures'
        """,
    ),
    "cb_once": (
        ["cb"],
        """
        SELECT * FROM cb QUALIFY row_number() OVER (
          PARTITION BY instrument_key, window_start ORDER BY roll_rank DESC) = 1
        """,
    ),
    "rolls": (
        ["cb", "chain"],
        """
        SELECT instrument_key, ticker, roll_rank, active_from,
               product(ratio) OVER (PARTITION BY instrument_key ORDER BY active_from DESC
                                    ROWS UNBOUNDED PRECEDING) AS roll_factor
        FROM (
          SELECT s.*, coalesce(lead(first_close) OVER (PARTITION BY s.instrument_key
                                                       ORDER BY s.active_from)
                               / nullif(last_close, 0), 1) AS ratio
          FROM (
            SELECT c.instrument_key, c.ticker, c.roll_rank, c.active_from,
                   arg_min(b.close, b.window_start)
                     FILTER (b.session_end_date >= c.active_from) AS first_close,
                   arg_max(b.close, b.window_start)
                     FILTER (b.session_end_date < c.next_from) AS last_close
            FROM (SELECT *, lead(active_from) OVER (PARTITION BY instrument_key
                                                    ORDER BY active_from) AS next_from
                  FROM chain) c
            LEFT JOIN cb b ON b.instrument_key = c.instrument_key AND b.ticker = c.ticker
            GROUP BY ALL) s)
        """,
    ),
    "lp": (
        [],
        "SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN part"
        " ON l_partkey = p_partkey",
    ),
    "db": (["lp"], ""),  # filled below
    "dl": ([], ""),
    "instruments": (
        [],
        """
        SELECT DISTINCT ty || ':' || sym AS instrument_key, ty AS instrument_type, sym AS symbol
        FROM (
          SELECT CASE event_type WHEN 'signup' THEN 'forex' WHEN 'error' THEN 'indices'
                      ELSE 'futures' END AS ty, upper(event_type) AS sym FROM events
          UNION ALL SELECT 'stocks', p_brand FROM part
          UNION ALL SELECT 'options', p_type FROM part)
        """,
    ),
    "tickers": (
        [],
        """
        SELECT CASE p_partkey % 7 WHEN 0 THEN 'C:' WHEN 1 THEN 'I:' WHEN 4 THEN 'O:' ELSE '' END
               || replace(p_brand, 'Brand#', 'B') || 'X' || p_partkey
               || CASE p_partkey % 11 WHEN 0 THEN '.WS' WHEN 1 THEN '.A' ELSE '' END AS ticker,
               p_name AS name,
               CASE p_partkey % 7 WHEN 0 THEN 'fx' WHEN 1 THEN 'indices' WHEN 2 THEN 'otc'
                    WHEN 3 THEN 'crypto' WHEN 4 THEN 'options' ELSE 'stocks' END AS market,
               CASE WHEN p_partkey % 2 = 0 THEN 'us' ELSE 'global' END AS locale,
               p_type AS type, p_partkey % 5 <> 0 AS active,
               CASE p_partkey % 3 WHEN 0 THEN 'XNAS' WHEN 1 THEN 'XNYS' END AS primary_exchange,
               CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'usd' END AS currency_name
        FROM part
        """,
    ),
    "ticker_types": (
        [],
        """
        SELECT p_type AS code, p_type || ' x ' || count(*) AS description,
               unnest(['stocks', 'fx', 'indices']) AS asset_class, 'us' AS locale
        FROM part GROUP BY p_type
        """,
    ),
    "grid": (
        ["instruments"],
        """
        SELECT instrument_key, unnest(CASE WHEN instrument_type = 'options' THEN ['1min']
                                           ELSE ['1min', '1day'] END) AS resolution
        FROM instruments
        """,
    ),
    "catalog": (
        ["runs"],
        """
        SELECT instrument_key, ticker, resolution, run_id, count(*) AS row_count,
               min(window_start) AS window_start_min, max(window_start) AS window_start_max
        FROM runs GROUP BY 1, 2, 3, 4
        """,
    ),
}


def daily(symbol: str, source: str) -> str:
    """Daily bars of unit prices, opens and closes by arrival order."""
    arrival = "l_orderkey * 8 + l_linenumber + l_extendedprice / 1e6"
    return f"""
        SELECT 'stocks:' || symbol AS instrument_key, 'stocks' AS instrument_type, symbol,
               '1day' AS resolution, window_start,
               CAST(window_start AS DATE) AS session_end_date, symbol AS ticker,
               open, high, low, close, volume, transactions
        FROM (
          SELECT CAST({symbol} AS VARCHAR) AS symbol, l_shipdate AS window_start,
                 arg_min(l_extendedprice / l_quantity, {arrival}) AS open,
                 max(l_extendedprice / l_quantity) AS high,
                 min(l_extendedprice / l_quantity) AS low,
                 arg_max(l_extendedprice / l_quantity, {arrival}) AS close,
                 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume,
                 count(*) AS transactions
          FROM {source} GROUP BY 1, 2)
    """


CTES["db"] = (["lp"], daily("p_brand", "lp"))
CTES["dl"] = ([], daily("l_linenumber", "lineitem"))


def _actions(symbol: str, source: str, needs: list[str], bars: str, suffix: str) -> dict:
    """Splits and dividends with their cumulative factors, per symbol column."""
    key = f"'stocks:' || {symbol}"
    return {
        f"splits{suffix}": (
            needs,
            f"""
            SELECT {key} AS instrument_key, CAST(max(l_shipdate) AS DATE) AS execution_date,
                   CAST(1 + count(*) % 3 AS DOUBLE) AS split_ratio
            FROM {source} GROUP BY {symbol}, year(l_shipdate)
            """,
        ),
        f"sf{suffix}": (
            [f"splits{suffix}"],
            f"""
            SELECT *, product(1.0 / split_ratio) OVER (
                        PARTITION BY instrument_key ORDER BY execution_date DESC
                        ROWS UNBOUNDED PRECEDING) AS factor FROM splits{suffix}
            """,
        ),
        f"dividends{suffix}": (
            needs,
            f"""
            SELECT {key} AS instrument_key, CAST(min(l_shipdate) AS DATE) AS ex_dividend_date,
                   max(l_quantity) AS amount
            FROM {source} GROUP BY {symbol}, date_trunc('quarter', l_shipdate)
            """,
        ),
        f"prev_closes{suffix}": (
            [f"dividends{suffix}", bars],
            f"""
            SELECT d.*, b.close AS prev_close
            FROM dividends{suffix} d ASOF LEFT JOIN {bars} b
              ON d.instrument_key = b.instrument_key AND d.ex_dividend_date > b.session_end_date
            """,
        ),
        f"df{suffix}": (
            [f"prev_closes{suffix}"],
            f"""
            SELECT *, product(CASE WHEN prev_close > 0 AND amount > 0
                                    AND 1 - amount / prev_close > 0
                                    AND 1 - amount / prev_close <= 1
                                   THEN 1 - amount / prev_close ELSE 1 END) OVER (
                        PARTITION BY instrument_key ORDER BY ex_dividend_date DESC
                        ROWS UNBOUNDED PRECEDING) AS factor FROM prev_closes{suffix}
            """,
        ),
    }


CTES.update(_actions("p_brand", "lp", ["lp"], "db", ""))
CTES.update(_actions("l_linenumber", "lineitem", [], "dl", "l"))


def with_tables(body: str, *needed: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the needed tables and what they need, then the query."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in CTES[name][0]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    # a recursive table can't be materialised
    parts += [
        f"{n} AS {'' if n in q.split() else 'MATERIALIZED '}({q})" for n, q in (extra or {}).items()
    ]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def minutes(source: str, k: int, begin: str | None = None, end: str | None = None,
            timezone: str = "UTC", prices: tuple = ()) -> str:
    """Session-anchored k-minute bars of a table."""
    if begin is None:
        anchor = "min(window_start) OVER w"
        finish = "max(window_start) OVER w + INTERVAL 1 MINUTE"
    else:
        back = " - INTERVAL 1 DAY" if begin > end else ""

        def wall(clock: str, shift: str) -> str:
            return (
                f"(session_end_date{shift} + INTERVAL '{clock}') AT TIME ZONE '{timezone}'"
                " AT TIME ZONE 'UTC'"
            )

        anchor, finish = wall(f"{begin}:00", back), wall(f"{end}:00", "")
    return f"""
        SELECT instrument_key, session_end_date, start AS window_start,
               arg_min(open, (window_start, ticker)) AS open, max(high) AS high,
               min(low) AS low, arg_max(close, (window_start, ticker)) AS close,
               CAST(count(*) AS INTEGER) AS candle_count,
               arg_min(ticker, (window_start, ticker)) AS ticker,
               CAST(sum(volume) AS BIGINT) AS volume,
               CAST(sum(transactions) AS BIGINT) AS transactions,
               sum(dollar_volume) AS dollar_volume
        FROM (
          SELECT *, anchor + to_minutes(CAST(
                   floor(date_sub('minute', anchor, window_start) / {k}) AS BIGINT) * {k})
                   AS start
          FROM (SELECT *, {anchor} AS anchor, {finish} AS finish FROM {source}
                WINDOW w AS (PARTITION BY instrument_key, session_end_date)))
        WHERE start + INTERVAL {k} MINUTE <= finish
        GROUP BY 1, 2, 3
    """


def days(source: str, k: int, week: bool = False) -> str:
    """k-day bars from the first session, or ISO weeks."""
    period = "date_trunc('week', session_end_date)" if week else "session_end_date"
    anchor = f"CAST(min({period}) OVER w AS DATE)"
    return f"""
        SELECT instrument_key, min(session_end_date) AS session_end_date,
               min(window_start) AS window_start, arg_min(open, window_start) AS open,
               max(high) AS high, min(low) AS low, arg_max(close, window_start) AS close,
               CAST(count(*) AS INTEGER) AS candle_count,
               CAST(sum(volume) AS BIGINT) AS volume,
               CAST(sum(transactions) AS BIGINT) AS transactions
        FROM (
          SELECT *, (CAST({period} AS DATE) - anchor) // {k} AS bucket
          FROM (SELECT *, {anchor} AS anchor, max(session_end_date) OVER w AS last
                FROM {source} WINDOW w AS (PARTITION BY instrument_key)))
        WHERE anchor + CAST((bucket + 1) * {k} - 1 AS INTEGER) <= last
        GROUP BY instrument_key, bucket
    """


def asof_factor(bars: str, actions: str, date: str, op: str = "*") -> str:
    """Bars with OHLC scaled by the factor of the first action after their date."""
    factor = "coalesce(nullif(a.factor, 0), 1)"
    scaled = ", ".join(f"b.{c} {op} {factor} AS {c}" for c in ("open", "high", "low", "close"))
    return f"""
        SELECT b.* REPLACE ({scaled})
        FROM {bars} b ASOF LEFT JOIN {actions} a
          ON b.instrument_key = a.instrument_key AND b.session_end_date < a.{date}
    """
