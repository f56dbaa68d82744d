"""Registered queries: panels, returns, risk, portfolios, allocation, baskets, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import allocate, basket, panel, portfolio, rates, resample, risk
from barloom.operators.adjust import dividend_factors, split_factors
from barloom.plans.bar_query import BarQuery
from barloom.plans.basket import query_baskets
from barloom.plans.portfolio import study
from barloom.schema import FRONTIER_POINTS, SAMPLES
from barloom.session import materialize, scratch_path
from barloom.sources import manifest, store
from workload import derive as d
from workload import sql
from workload.registry import query
from workload.sql import with_tables

RATE = 0.04

# Line numbers trade almost every day: a dense daily panel under the default threshold.
DENSE = {
    "universes": """
        SELECT u AS universe, 'stocks:' || symbol AS instrument_key, symbol
        FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS symbol FROM lineitem),
             LATERAL (SELECT unnest(['all', 'half-' || ((length(symbol)
                        + ascii(right(symbol, 1))) % 2)]) AS u)
    """,
    "closes": """
        SELECT universe, symbol, session_end_date AS date, close
        FROM dl JOIN universes USING (instrument_key, symbol)
    """,
}
# The same by week, adjusted.
WEEKLY = {
    "universes": DENSE["universes"],
    "weeks": sql.days("adjusted", 7, True),
    "closes": """
        SELECT universe, symbol, CAST(window_start AS DATE) AS date, close
        FROM weeks JOIN universes USING (instrument_key)
    """,
}
# Brands by day: about half of the dates.
SPARSE = {
    "universes": """
        SELECT u AS universe, 'stocks:' || symbol AS instrument_key, symbol
        FROM (SELECT DISTINCT p_brand AS symbol FROM part),
             LATERAL (SELECT unnest(['all', 'half-' || ((length(symbol)
                        + ascii(right(symbol, 1))) % 2)]) AS u)
    """,
    "closes": """
        SELECT universe, symbol, session_end_date AS date, close
        FROM db JOIN universes USING (instrument_key, symbol)
    """,
}


def _whole_dates(value: str, known: str) -> str:
    """Returns on the dates on which every symbol of the universe has one."""
    return f"""
            SELECT universe, symbol, date, ret
            FROM (SELECT *, {value.replace("ln(growth)", "ln(CASE WHEN growth > 0 THEN growth END)")}
                         AS ret, count(*) FILTER ({known}) OVER (PARTITION BY universe, date)
                         AS present FROM grown)
            WHERE present = members
        """


def panel_ctes(min_coverage: float) -> dict[str, str]:
    return {
        "cover": f"""
            SELECT universe, symbol, n_obs, n_dates, n_obs / n_dates AS coverage,
                   n_obs / n_dates >= {min_coverage}::DOUBLE AS kept
            FROM (SELECT universe, symbol, count(close) AS n_obs FROM closes GROUP BY 1, 2)
            JOIN (SELECT universe, count(DISTINCT date) AS n_dates FROM closes GROUP BY 1)
              USING (universe)
        """,
        "panel": """
            SELECT * FROM (
              SELECT universe, symbol, date, close,
                     count(*) OVER (PARTITION BY universe, symbol) AS n
              FROM (SELECT c.*, count(*) OVER (PARTITION BY universe, date) AS present, k.n_kept
                    FROM closes c
                    JOIN (SELECT universe, symbol, count(*) OVER (PARTITION BY universe) AS n_kept
                          FROM cover WHERE kept) k USING (universe, symbol))
              WHERE present = n_kept AND n_kept >= 2)
            WHERE n >= 5
        """,
        "grown": """
            SELECT universe, symbol, date, close / nullif(lag(close) OVER (
                     PARTITION BY universe, symbol ORDER BY date), 0) AS growth,
                   count(*) OVER (PARTITION BY universe, date) AS members
            FROM panel
        """,
        "rets": _whole_dates("growth - 1", "growth IS NOT NULL"),
        "log_rets": _whole_dates("ln(growth)", "growth > 0"),
    }


STATS = {
    "stats": f"""
        SELECT *, CASE WHEN vol_ann > 1e-15
                       THEN (mean_ann - {RATE}::DOUBLE) / vol_ann END AS sharpe
        FROM (SELECT universe, symbol, avg(ret) * 252 AS mean_ann,
                     stddev_samp(ret) * sqrt(252) AS vol_ann, count(*) AS n_obs
              FROM rets GROUP BY 1, 2)
    """,
    "moments": """
        SELECT universe, a.symbol AS symbol_a, b.symbol AS symbol_b,
               covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr, count(*) AS n_obs
        FROM rets a JOIN rets b USING (universe, date) GROUP BY 1, 2, 3
    """,
    "cov": """
        SELECT universe, symbol_a, symbol_b,
               cov * 252 + CASE WHEN symbol_a = symbol_b THEN 1e-10 ELSE 0 END AS cov
        FROM moments
    """,
}
WEIGHTS = {
    "samples": f"""
        SELECT universe, 'sample-' || i AS portfolio_id, symbol,
               draw / sum(draw) OVER (PARTITION BY universe, i) AS weight
        FROM (SELECT universe, symbol, i,
                     -ln((('0x' || substr(md5('42|' || i || '|' || symbol), 1, 13))::BIGINT + 0.5)
                         / pow(16::DOUBLE, 13)) AS draw
              FROM stats, range(1, {SAMPLES + 1}) AS r(i))
    """,
    "weights": """
        SELECT * FROM samples UNION ALL
        SELECT universe, 'equal', symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY universe)
        FROM stats
    """,
    "evaluated": f"""
        SELECT *, CASE WHEN vol_ann > 1e-15
                       THEN (mean_ann - {RATE}::DOUBLE) / vol_ann END AS sharpe
        FROM (SELECT w.universe, w.portfolio_id, sum(w.weight * s.mean_ann) AS mean_ann
              FROM weights w JOIN stats s USING (universe, symbol) GROUP BY 1, 2)
        JOIN (SELECT a.universe, a.portfolio_id,
                     sqrt(greatest(sum(a.weight * b.weight * c.cov), 0)) AS vol_ann
              FROM weights a JOIN weights b USING (universe, portfolio_id)
              JOIN cov c ON c.universe = a.universe AND c.symbol_a = a.symbol
                        AND c.symbol_b = b.symbol
              GROUP BY 1, 2) USING (universe, portfolio_id)
    """,
}
DENSE_ALL = {**DENSE, **panel_ctes(0.95)}
RISK = {**DENSE_ALL, **STATS}
CHOICE = {**RISK, **WEIGHTS}


def _universes(s, sf):
    return materialize(d.universes(s, sf, "l_linenumber"), "universes")


def _dense_closes(s, sf):
    members = _universes(s, sf)
    closes = panel.panel_closes(d.daily_bars(s, sf, "l_linenumber"), members)
    return materialize(closes, "closes"), members


def _line_split_factors(s, sf):
    return materialize(split_factors(d.splits(s, sf, "l_linenumber")), "splits")


def _line_dividend_factors(s, sf):
    dividends = materialize(d.dividends(s, sf, "l_linenumber"), "ex-dates")
    factors = dividend_factors(dividends, d.daily_bars(s, sf, "l_linenumber"))
    return materialize(factors, "dividends")


def _sparse_closes(s, sf):
    members = materialize(d.universes(s, sf), "universes")
    return materialize(panel.panel_closes(d.daily_bars(s, sf), members), "closes"), members


def _panel(s, sf):
    return panel.price_panel(*_dense_closes(s, sf))


def _returns(s, sf):
    return panel.returns(_panel(s, sf))


def _stats(rets):
    return risk.asset_stats(rets, panel.periods_per_year("day"), RATE)


def _cov(rets):
    return risk.regularized(risk.covariance_matrix(risk.pair_moments(rets), 252.0))


def _symbols(rets):
    return rets.select("universe", "symbol").distinct()


def _weights(rets):
    symbols = _symbols(rets)
    sampled = portfolio.sampled_weights(symbols, SAMPLES)
    return sampled.unionByName(portfolio.equal_weights(symbols))


def _evaluated(rets):
    return portfolio.performance(
        _weights(rets), _stats(rets), materialize(_cov(rets), "covariance"), RATE,
        portfolios=SAMPLES + 1,
    )


def on_returns(build):
    """A query over the returns, which several of its steps read."""
    return lambda s, sf: build(materialize(_returns(s, sf), "returns"))


def _weekly_panel(s, sf):
    members = _universes(s, sf)
    closes = panel.panel_closes(
        d.daily_bars(s, sf, "l_linenumber"),
        members,
        splits=_line_split_factors(s, sf),
        dividends=_line_dividend_factors(s, sf),
        timescale="week",
    )
    return panel.price_panel(materialize(closes, "closes"), members, 0.8)


# --- panel and returns ----------------------------------------------------------------------

query(
    "panel_coverage",
    lambda s, sf: panel.panel_coverage(_sparse_closes(s, sf)[0], 0.6),
    "universe symbol n_obs n_dates coverage:8 kept",
    with_tables("SELECT * FROM cover", "db", extra={**SPARSE, **panel_ctes(0.6)}),
)
query(
    "panel_status",
    lambda s, sf: panel.panel_status(*_sparse_closes(s, sf), 0.6),
    "universe n_kept n_dates n_dropped status",
    with_tables(
        """
        SELECT universe, n_kept, coalesce(n_dates, 0) AS n_dates, n_dropped,
               CASE WHEN n_kept = 0 THEN 'no_prices' WHEN n_kept < 2 THEN 'too_few_symbols'
                    WHEN coalesce(n_dates, 0) = 0 THEN 'too_few_dates' ELSE 'ok' END AS status
        FROM (SELECT universe, count(*) FILTER (kept) AS n_kept,
                     count(*) FILTER (NOT kept) AS n_dropped FROM cover GROUP BY 1)
        LEFT JOIN (SELECT universe, count(DISTINCT date) AS n_dates FROM panel GROUP BY 1)
          USING (universe)
        """,
        "db",
        extra={**SPARSE, **panel_ctes(0.6)},
    ),
)
query(
    "price_panel",
    _panel,
    "universe symbol date:s close:6",
    with_tables("SELECT * FROM panel", "dl", extra=DENSE_ALL),
)
query(
    "price_panel_weekly_adjusted",
    _weekly_panel,
    "universe symbol date:s close:6",
    with_tables(
        "SELECT * FROM panel",
        "dl",
        "sfl",
        "dfl",
        extra={
            "split_adjusted": sql.asof_factor("dl", "sfl", "execution_date"),
            "adjusted": sql.asof_factor("split_adjusted", "dfl", "ex_dividend_date"),
            **WEEKLY,
            **panel_ctes(0.8),
        },
    ),
)
query(
    "panel_wide",
    lambda s, sf: panel.wide(_panel(s, sf), [str(i) for i in range(1, 8)]),
    "universe date:s 1:6 2:6 3:6 4:6 5:6 6:6 7:6",
    with_tables(
        "SELECT universe, date, "
        + ", ".join(f"max(close) FILTER (symbol = '{i}') AS \"{i}\"" for i in range(1, 8))
        + " FROM panel GROUP BY 1, 2",
        "dl",
        extra=DENSE_ALL,
    ),
)
query(
    "returns_simple",
    _returns,
    "universe symbol date:s ret:8",
    with_tables("SELECT * FROM rets", "dl", extra=DENSE_ALL),
)
query(
    "returns_log",
    lambda s, sf: panel.returns(_panel(s, sf), "log"),
    "universe symbol date:s ret:8",
    with_tables("SELECT * FROM log_rets", "dl", extra=DENSE_ALL),
)
query(
    "latest_prices",
    lambda s, sf: panel.latest_prices(_panel(s, sf)),
    "universe symbol price:6",
    with_tables(
        "SELECT universe, symbol, arg_max(close, date) AS price FROM panel GROUP BY 1, 2",
        "dl",
        extra=DENSE_ALL,
    ),
)

# --- risk -----------------------------------------------------------------------------------

query(
    "asset_stats",
    on_returns(lambda rets: risk.rank_stats(_stats(rets))),
    "universe symbol mean_ann:5 vol_ann:5 sharpe:5 n_obs",
    with_tables("SELECT * FROM stats", "dl", extra=RISK),
)
query(
    "correlation_matrix",
    on_returns(lambda rets: risk.mirrored(risk.correlation_matrix(risk.pair_moments(rets)))),
    "universe symbol_a symbol_b corr:8",
    with_tables("SELECT * FROM moments", "dl", extra=RISK),
)
query(
    "covariance_matrix",
    on_returns(lambda rets: risk.mirrored(risk.covariance_matrix(risk.pair_moments(rets, 2), 252.0))),
    "universe symbol_a symbol_b cov:3",
    with_tables("SELECT * REPLACE (cov * 252 AS cov) FROM moments", "dl", extra=RISK),
)
query(
    "regularized_covariance",
    on_returns(lambda rets: risk.mirrored(_cov(rets))),
    "universe symbol_a symbol_b cov:3",
    with_tables("SELECT * FROM cov", "dl", extra=RISK),
)

# --- portfolios -----------------------------------------------------------------------------

query(
    "equal_weights",
    on_returns(lambda rets: portfolio.equal_weights(_symbols(rets))),
    "universe portfolio_id symbol weight:9",
    with_tables(
        "SELECT * FROM weights WHERE portfolio_id = 'equal'", "dl", extra=CHOICE
    ),
)
query(
    "sampled_weights",
    on_returns(lambda rets: portfolio.sampled_weights(_symbols(rets), SAMPLES)),
    "universe portfolio_id symbol weight:9",
    with_tables("SELECT * FROM samples", "dl", extra=CHOICE),
)
query(
    "portfolio_performance",
    on_returns(_evaluated),
    "universe portfolio_id mean_ann:5 vol_ann:5 sharpe:5",
    with_tables("SELECT * FROM evaluated", "dl", extra=CHOICE),
)
query(
    "select_min_volatility",
    on_returns(lambda rets: portfolio.select_best(_evaluated(rets), "min_variance")),
    "universe objective portfolio_id mean_ann:5 vol_ann:5 sharpe:5",
    with_tables(
        "SELECT *, 'min-vol' AS objective FROM evaluated QUALIFY row_number() OVER ("
        "PARTITION BY universe ORDER BY vol_ann, portfolio_id) = 1",
        "dl",
        extra=CHOICE,
    ),
)
query(
    "select_max_sharpe",
    on_returns(lambda rets: portfolio.select_best(_evaluated(rets), "tangency")),
    "universe objective portfolio_id mean_ann:5 vol_ann:5 sharpe:5",
    with_tables(
        "SELECT *, 'max-sharpe' AS objective FROM evaluated WHERE sharpe IS NOT NULL"
        " QUALIFY row_number() OVER (PARTITION BY universe"
        " ORDER BY sharpe DESC, portfolio_id) = 1",
        "dl",
        extra=CHOICE,
    ),
)
query(
    "weights_table",
    on_returns(
        lambda rets: portfolio.weights_table(
            _weights(rets), portfolio.select_best(_evaluated(rets), "min-vol")
        )
    ),
    "universe portfolio_id objective symbol weight:8 mean_ann:5 vol_ann:5 sharpe:5",
    with_tables(
        "SELECT w.weight, w.symbol, 'min-vol' AS objective, e.* FROM weights w"
        " JOIN (SELECT * FROM evaluated QUALIFY row_number() OVER (PARTITION BY universe"
        " ORDER BY vol_ann, portfolio_id) = 1) e USING (universe, portfolio_id)"
        " WHERE weight >= 1e-6",
        "dl",
        extra=CHOICE,
    ),
)
query(
    "efficient_frontier",
    on_returns(
        lambda rets: portfolio.frontier(materialize(_evaluated(rets), "evaluated"))
    ),
    "universe portfolio_id mean_ann:5 vol_ann:5 sharpe:5",
    with_tables(
        f"""
        SELECT * FROM (
          SELECT *, max(mean_ann) OVER (PARTITION BY universe ORDER BY vol_ann, mean_ann
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far
          FROM (
            SELECT e.* FROM evaluated e
            JOIN (SELECT universe, min(mean_ann) AS lo, max(mean_ann) AS hi,
                         (max(mean_ann) - min(mean_ann)) / {FRONTIER_POINTS} AS step
                  FROM evaluated GROUP BY 1) s USING (universe), range({FRONTIER_POINTS}) AS r(b)
            WHERE mean_ann >= lo + b * step
              AND mean_ann <= CASE WHEN b = {FRONTIER_POINTS - 1} THEN hi ELSE lo + (b + 1) * step END
            QUALIFY row_number() OVER (PARTITION BY universe, b
                                       ORDER BY vol_ann, portfolio_id) = 1))
        WHERE so_far IS NULL OR mean_ann >= so_far - 1e-12
        """,
        "dl",
        extra=CHOICE,
    ),
)
query(
    "portfolio_study",
    lambda s, sf: portfolio.select_best(
        study(
            d.daily_bars(s, sf, "l_linenumber"),
            _universes(s, sf),
            splits=_line_split_factors(s, sf),
        ).evaluated,
        "max-sharpe",
    ),
    "universe objective portfolio_id mean_ann:5 vol_ann:5 sharpe:5",
    with_tables(
        "SELECT *, 'max-sharpe' AS objective FROM evaluated WHERE sharpe IS NOT NULL"
        " QUALIFY row_number() OVER (PARTITION BY universe"
        " ORDER BY sharpe DESC, portfolio_id) = 1",
        "dl",
        "sfl",
        extra={
            "adjusted": sql.asof_factor("dl", "sfl", "execution_date"),
            **CHOICE,
            "closes": DENSE["closes"].replace("FROM dl", "FROM adjusted"),
        },
    ),
)

# --- closes that are zero or below, on different dates of different symbols -------------------

GAPS = {
    **RISK,
    "closes": """
        SELECT universe, symbol, session_end_date AS date,
               CASE WHEN symbol = '1' AND day(session_end_date) = 5 THEN 0
                    WHEN symbol = '2' AND day(session_end_date) = 9 THEN -close
                    ELSE close END AS close
        FROM dl JOIN universes USING (instrument_key, symbol)
    """,
}


def _returns_with_gaps(s, sf, kind):
    closes, members = _dense_closes(s, sf)
    day, symbol = F.dayofmonth("date"), F.col("symbol")
    close = (
        F.when((symbol == "1") & (day == 5), 0.0)
        .when((symbol == "2") & (day == 9), -F.col("close"))
        .otherwise(F.col("close"))
    )
    rows = panel.price_panel(closes.withColumn("close", close), members)
    return materialize(panel.returns(rows, kind), "returns")


for _kind, _table in (("simple", "rets"), ("log", "log_rets")):
    query(
        f"returns_{_kind}_with_gaps",
        lambda s, sf, kind=_kind: _returns_with_gaps(s, sf, kind),
        "universe symbol date:s ret:8",
        with_tables(f"SELECT * FROM {_table}", "dl", extra=GAPS),
    )
query(
    "moments_with_gaps",
    lambda s, sf: risk.pair_moments(_returns_with_gaps(s, sf, "log"), 2),
    "universe symbol_a symbol_b cov:5 corr:6 n_obs",
    with_tables(
        """
        SELECT universe, a.symbol AS symbol_a, b.symbol AS symbol_b,
               covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr, count(*) AS n_obs
        FROM log_rets a JOIN log_rets b USING (universe, date)
        WHERE a.symbol <= b.symbol GROUP BY 1, 2, 3
        """,
        "dl",
        extra=GAPS,
    ),
)

# --- allocation -----------------------------------------------------------------------------

CAPITAL = 250_000.0


def _allocation(s, sf):
    prices = materialize(_panel(s, sf), "panel")
    return allocate.allocate_discrete(
        _weights(prices), panel.latest_prices(prices), CAPITAL
    )


ALLOCATION = {
    **CHOICE,
    "prices": "SELECT universe, symbol, arg_max(close, date) AS price FROM panel GROUP BY 1, 2",
    "lots": f"""
        SELECT *, CASE WHEN target + 1e-9 >= price
                       THEN CAST(floor(target / price + 1e-12) AS BIGINT) ELSE 0 END AS fl,
               CASE WHEN target + 1e-9 >= price
                    THEN CAST(ceil(target / price - 1e-12) AS BIGINT) ELSE 0 END AS cap
        FROM (SELECT *, weight_th * {CAPITAL}::DOUBLE AS target
              FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY universe, portfolio_id)
                              AS weight_th
                    FROM weights JOIN prices USING (universe, symbol)
                    WHERE weight >= 1e-6 AND price > 0 AND price <= {CAPITAL}))
    """,
    "ordered": f"""
        SELECT *, row_number() OVER (PARTITION BY universe, portfolio_id
                                     ORDER BY target - fl * price DESC, symbol) AS pos,
               {CAPITAL}::DOUBLE - sum(fl * price) OVER (PARTITION BY universe, portfolio_id)
                 AS cash0
        FROM lots
    """,
    "walk": """
        SELECT universe, portfolio_id, symbol, pos,
               fl < cap AND target - fl * price > 1e-9 AND price <= cash0 + 1e-12 AS buy,
               CASE WHEN fl < cap AND target - fl * price > 1e-9 AND price <= cash0 + 1e-12
                    THEN cash0 - price ELSE cash0 END AS cash
        FROM ordered WHERE pos = 1
        UNION ALL
        SELECT o.universe, o.portfolio_id, o.symbol, o.pos,
               fl < cap AND target - fl * price > 1e-9 AND price <= w.cash + 1e-12,
               CASE WHEN fl < cap AND target - fl * price > 1e-9 AND price <= w.cash + 1e-12
                    THEN w.cash - price ELSE w.cash END
        FROM walk w JOIN ordered o ON o.universe = w.universe
         AND o.portfolio_id = w.portfolio_id AND o.pos = w.pos + 1
    """,
    "allocated": """
        SELECT *, shares * price AS notional,
               sum(shares * price) OVER (PARTITION BY universe, portfolio_id) AS invested
        FROM (SELECT o.*, fl + CASE WHEN buy THEN 1 ELSE 0 END AS shares
              FROM ordered o JOIN walk USING (universe, portfolio_id, symbol))
    """,
}


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


query(
    "lots_table",
    lambda s, sf: allocate.lots_table(_allocation(s, sf)),
    "universe portfolio_id symbol shares price:4 notional:3 weight_th:7 weight_eff:7",
    _recursive(
        with_tables(
            "SELECT *, notional / invested AS weight_eff FROM allocated WHERE shares > 0",
            "dl",
            extra=ALLOCATION,
        )
    ),
)
query(
    "allocation_summary",
    lambda s, sf: allocate.allocation_summary(_allocation(s, sf)),
    "universe portfolio_id invested:3 cash:3 drift_l1:7 lots",
    _recursive(
        with_tables(
            f"""
            SELECT universe, portfolio_id, max(invested) AS invested,
                   {CAPITAL} - max(invested) AS cash,
                   sum(abs(weight_th - coalesce(notional / nullif(invested, 0), 0)))
                     AS drift_l1,
                   count(*) FILTER (shares > 0) AS lots
            FROM allocated GROUP BY 1, 2
            """,
            "dl",
            extra=ALLOCATION,
        )
    ),
)
query(
    "skipped_symbols",
    lambda s, sf: (
        lambda prices: allocate.skipped_symbols(
            portfolio.equal_weights(_symbols(prices)), panel.latest_prices(prices), 2000.0
        )
    )(materialize(_panel(s, sf), "panel")),
    "universe portfolio_id symbol reason",
    with_tables(
        "SELECT universe, portfolio_id, symbol, 'price_above_capital' AS reason"
        " FROM weights JOIN prices USING (universe, symbol)"
        " WHERE portfolio_id = 'equal' AND price > 2000",
        "dl",
        extra=ALLOCATION,
    ),
)

# --- baskets and rates ----------------------------------------------------------------------


def _basket_weights(s, sf):
    """One basket per pair of universes, weighted by traded quantity; one leg never trades."""
    volume = d.table(s, sf, "lineitem").groupBy(
        F.col("l_linenumber").cast("string").alias("symbol")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("weight"))
    legs = _universes(s, sf).join(volume, "symbol").select(
        F.col("universe").alias("basket"), "instrument_key", "weight"
    )
    absent = legs.groupBy("basket").agg(F.max("weight").alias("weight")).select(
        "basket", F.lit("stocks:none").alias("instrument_key"), "weight"
    )
    return materialize(legs.unionByName(absent), "basket-weights")


BASKET = {
    "universes": DENSE["universes"],
    "legs": """
        SELECT universe AS basket, instrument_key,
               w / sum(w) OVER (PARTITION BY universe) AS weight,
               count(*) OVER (PARTITION BY universe) AS legs
        FROM universes JOIN (
          SELECT CAST(l_linenumber AS VARCHAR) AS symbol,
                 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS w
          FROM lineitem GROUP BY 1) USING (symbol)
    """,
    "combined": """
        SELECT basket, window_start, sum(open * weight) AS open, sum(high * weight) AS high,
               sum(low * weight) AS low, sum(close * weight) AS close,
               sum(volume * weight) AS volume
        FROM dl JOIN legs USING (instrument_key) GROUP BY 1, 2 HAVING count(*) = max(legs)
    """,
    "basket_bars": """
        SELECT 'portfolio:' || basket AS instrument_key, window_start,
               CAST(window_start AS DATE) AS session_end_date, 'PORTFOLIO' AS ticker,
               open * 100 / base AS open, high * 100 / base AS high, low * 100 / base AS low,
               close * 100 / base AS close, volume, 0 AS transactions,
               close * 100 / base * volume AS dollar_volume
        FROM combined JOIN (SELECT basket, arg_min(close, window_start) AS base
                            FROM combined GROUP BY 1) USING (basket)
    """,
}

query(
    "basket_bars",
    lambda s, sf: basket.basket_bars(
        d.daily_bars(s, sf, "l_linenumber"), _basket_weights(s, sf)
    ),
    "instrument_key window_start:s ticker open:5 high:5 low:5 close:5 volume:4 dollar_volume:1",
    with_tables("SELECT * FROM basket_bars", "dl", extra=BASKET),
)
query(
    "basket_weeks",
    lambda s, sf: resample.resample_days(
        materialize(
            basket.basket_bars(d.daily_bars(s, sf, "l_linenumber"), _basket_weights(s, sf)),
            "basket-bars",
        ),
        7,
        week_aligned=True,
    ),
    "instrument_key window_start:s session_end_date:s open:5 high:5 low:5 close:5 candle_count",
    with_tables(sql.days("basket_bars", 7, True), "dl", extra=BASKET),
)


def _adjusted_basket_weeks(s, sf):
    """Stored daily bars; which of them trade is read from their manifest."""
    root = scratch_path(s, "bars")
    store.write_bars(d.daily_bars(s, sf, "l_linenumber").withColumns(
        {"instrument_type": F.lit("stocks"), "resolution": F.lit("1day"),
         "symbol": F.substring_index("instrument_key", ":", -1)}), root)
    bars = store.read_bars(s, root, resolution="1day")
    splits = materialize(split_factors(d.splits(s, sf, "l_linenumber")), "splits")
    ex_dates = materialize(d.dividends(s, sf, "l_linenumber"), "ex-dates")
    return query_baskets(
        bars, _basket_weights(s, sf), BarQuery("1week", adjust=True),
        traded=manifest.held_rows(store.bars_log(s, root)),
        splits=splits,
        dividends=materialize(dividend_factors(ex_dates, bars), "dividends"),
    )


query(
    "basket_adjusted_weeks",
    _adjusted_basket_weeks,
    "instrument_key window_start:s session_end_date:s open:5 high:5 low:5 close:5 candle_count",
    with_tables(
        sql.days("basket_bars", 7, True),
        "dl",
        "sfl",
        "dfl",
        extra={
            "split_adjusted": sql.asof_factor("dl", "sfl", "execution_date"),
            "adjusted": sql.asof_factor("split_adjusted", "dfl", "ex_dividend_date"),
            **BASKET,
            "combined": BASKET["combined"].replace("FROM dl", "FROM adjusted"),
        },
    ),
)
query(
    "yield_quotes",
    lambda s, sf: rates.yield_quotes(d.daily_bars(s, sf)),
    "instrument_key rate:8 as_of:s",
    with_tables(
        "SELECT instrument_key, arg_max(close, session_end_date) / 100 AS rate,"
        " max(session_end_date) AS as_of FROM db GROUP BY 1",
        "db",
    ),
)
query(
    "resolve_rates",
    lambda s, sf: rates.resolve_rates(
        d.instruments(s, sf).select(
            F.col("instrument_key").alias("series_key"),
            F.when(F.length("symbol") % 2 == 0, F.length("symbol") / 1000).alias("explicit_rate"),
        ),
        rates.yield_quotes(d.daily_bars(s, sf)),
        0.04,
    ),
    "series_key explicit_rate:6 risk_free_rate:8 source as_of:s",
    with_tables(
        """
        SELECT instrument_key AS series_key, e AS explicit_rate,
               coalesce(e, rate, 0.04::DOUBLE) AS risk_free_rate,
               CASE WHEN e IS NOT NULL THEN 'explicit' WHEN rate IS NOT NULL THEN 'series'
                    ELSE 'static' END AS source,
               CASE WHEN e IS NULL THEN as_of END AS as_of
        FROM (SELECT *, CASE WHEN length(symbol) % 2 = 0 THEN length(symbol) / 1000 END AS e
              FROM instruments)
        LEFT JOIN (SELECT instrument_key, arg_max(close, session_end_date) / 100 AS rate,
                          max(session_end_date) AS as_of FROM db GROUP BY 1)
          USING (instrument_key)
        """,
        "instruments",
        "db",
    ),
)
