"""Registered queries: landed payloads, stored tables, overlays and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import planning
from barloom.operators.adjust import split_factors
from barloom.operators.coverage import with_lag
from barloom.operators.merge import merge_runs
from barloom.operators.resample import resample_days
from barloom.plans.bar_query import BarQuery, query_latest_page
from barloom.session import materialize, scratch_path, stateful_session
from barloom.sources import landing, manifest, overlays, store
from barloom.sources import tickers as shards
from barloom.sources.widening import read_widened_runs
from barloom.streaming.freshness import freshness_view, start_monitor, wait_until_drained
from barloom.streaming.merge import landed_runs, start_bars, start_merge
from barloom.streaming.sessions import session_bars_view, start_session_bars
from workload import derive as d
from workload import sql
from workload.registry import query
from workload.sql import with_tables

OHLC = "open:6 high:6 low:6 close:6"


def _results(rows, by, item):
    """One ``{"results": [...]}`` payload per group of at most a month."""
    return rows.groupBy(*by).agg(
        F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("payload")
    )


# --- landed payloads ------------------------------------------------------------------------


def _futures_payloads(s, sf):
    """One payload per contract; epoch nanoseconds as text for every other product."""
    bars = d.contract_bars(s, sf)
    nanos = F.unix_micros(F.col("window_start").cast("timestamp")) * 1000
    item = F.struct(
        "ticker",
        nanos.cast("string").alias("window_start"),
        F.col("session_end_date").cast("string").alias("session_end_date"),
        "open", "high", "low", "close", "volume", "transactions", "dollar_volume",
    )
    return _results(
        bars.withColumn("_day", F.to_date("window_start")),
        [F.col("symbol").alias("product_code"), "ticker", "_day"],
        item,
    )


def _landed(s, payloads, keys):
    """Payloads written to storage, a line each, and read back from there."""
    root = scratch_path(s, "landed")
    payloads.select(*keys, "payload").write.partitionBy(*keys).text(root)
    return landing.read_payloads(s, root)


query(
    "land_futures_bars",
    lambda s, sf: landing.futures_bars(_landed(s, _futures_payloads(s, sf), ["product_code"])),
    f"instrument_key ticker window_start:s session_end_date:s {OHLC} volume transactions",
    with_tables("SELECT * FROM cb", "cb"),
)


def _v2_payloads(s, sf):
    bars = d.minute_bars(s, sf).filter("instrument_type <> 'futures'")
    item = F.struct(
        F.unix_millis(F.col("window_start").cast("timestamp")).alias("t"),
        F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
        F.col("close").alias("c"), F.col("volume").cast("double").alias("v"),
        F.col("transactions").alias("n"), F.col("close").alias("vw"),
    )
    return _results(
        bars.withColumn("_day", F.to_date("window_start")),
        ["instrument_type", "symbol", "_day"], item,
    )


query(
    "land_v2_bars",
    lambda s, sf: landing.v2_bars(
        _landed(s, _v2_payloads(s, sf), ["instrument_type", "symbol"])
    ),
    f"instrument_key ticker window_start:s session_end_date:s {OHLC} volume transactions "
    "dollar_volume:2 vwap:6",
    with_tables("SELECT *, close AS vwap FROM mb WHERE instrument_type <> 'futures'", "mb"),
)


def _spoiled_payloads(s, sf):
    """Every event as a bar; some epochs are no numbers, and some days' payloads are cut off."""
    events = d.table(s, sf, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    spoiled = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "event_id")).otherwise(millis)
    day = F.to_date("ts").cast("string").alias("day")
    item = F.struct(spoiled.alias("t"), F.col("value").alias("o"))
    rows = _results(events, [F.upper("event_type").alias("symbol"), day], item)
    cut = F.col("day").endswith("3")
    text = F.when(cut, F.concat(F.lit("cut "), F.col("day"))).otherwise(F.col("payload"))
    return rows.withColumn("payload", text)


query(
    "land_rejects",
    lambda s, sf: landing.rejects(_landed(s, _spoiled_payloads(s, sf), ["symbol"]), time="t"),
    "symbol reason text",
    """
    SELECT upper(event_type) AS symbol, 'malformed epoch' AS reason, 'x' || event_id AS text
    FROM events WHERE event_id % 5 = 0 AND strftime(ts, '%Y-%m-%d') NOT LIKE '%3'
    UNION ALL
    SELECT DISTINCT upper(event_type), 'unreadable payload', 'cut ' || strftime(ts, '%Y-%m-%d')
    FROM events WHERE strftime(ts, '%Y-%m-%d') LIKE '%3'
    """,
)


def _chart_payloads(s, sf):
    """One daily chart per brand and year; bars of one trade lack their open or volume."""
    thin = F.col("transactions") == 1
    bars = d.daily_bars(s, sf).select(
        "instrument_key",
        "symbol",
        F.year("window_start").alias("year"),
        F.struct(
            (F.unix_timestamp(F.col("window_start").cast("timestamp")) + 52200).alias("ts"),
            F.when(~(thin & (F.col("volume") % 2 == 0)), F.col("open")).alias("open"),
            "high", "low", "close",
            F.when(~thin, F.col("volume").cast("double")).alias("volume"),
        ).alias("bar"),
    ).groupBy("instrument_key", "symbol", "year").agg(F.array_sort(F.collect_list("bar")).alias("b"))

    def events(rows, date, value):
        item = F.struct(F.unix_timestamp(F.col(date).cast("timestamp")).alias("date"), *value)
        return rows.groupBy("instrument_key", F.year(date).alias("year")).agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.col(date).cast("string").alias("k"), item.alias("v")))
            ).alias(date)
        )

    ratio = F.col("split_ratio").cast("int")
    odd = F.dayofmonth("execution_date") % 2 == 1
    splits = events(
        d.splits(s, sf),
        "execution_date",
        [
            F.when(odd, F.col("split_ratio")).alias("numerator"),
            F.when(odd, F.lit(1.0)).alias("denominator"),
            F.concat(ratio, F.lit(":1")).alias("splitRatio"),
        ],
    )
    dividends = events(d.dividends(s, sf), "ex_dividend_date", [F.col("amount").alias("amount")])
    chart = F.struct(
        F.array(
            F.struct(
                F.col("b.ts").alias("timestamp"),
                F.struct(
                    F.array(
                        F.struct(*[F.col(f"b.{c}").alias(c)
                                   for c in ("open", "high", "low", "close", "volume")])
                    ).alias("quote")
                ).alias("indicators"),
                F.struct(
                    F.col("execution_date").alias("splits"),
                    F.col("ex_dividend_date").alias("dividends"),
                ).alias("events"),
            )
        ).alias("result")
    )
    return (
        bars.join(splits, ["instrument_key", "year"], "left")
        .join(dividends, ["instrument_key", "year"], "left")
        .select("instrument_key", "symbol",
                F.to_json(F.struct(chart.alias("chart")), {"ignoreNullFields": "false"})
                .alias("payload"))
    )


CHART_BARS = (
    "SELECT * REPLACE (CASE WHEN transactions = 1 THEN 0 ELSE volume END AS volume)"
    " FROM db WHERE NOT (transactions = 1 AND volume % 2 = 0)"
)
query(
    "land_chart_bars",
    lambda s, sf: landing.chart_bars(_chart_payloads(s, sf)),
    f"instrument_key ticker window_start:s session_end_date:s {OHLC} volume",
    with_tables(CHART_BARS, "db"),
)
query(
    "land_daily_raw_bars",
    lambda s, sf: landing.daily_raw_bars(
        _chart_payloads(s, sf), split_factors(landing.chart_splits(_chart_payloads(s, sf)))
    ),
    "instrument_key window_start:s open:3 high:3 low:3 close:3 volume",
    with_tables(
        "SELECT b.* REPLACE ("
        + ", ".join(f"{c} / coalesce(a.factor, 1) AS {c}" for c in ("open", "high", "low", "close"))
        + ") FROM chart b ASOF LEFT JOIN sf a ON b.instrument_key = a.instrument_key"
        " AND b.session_end_date < a.execution_date",
        "db",
        "sf",
        extra={"chart": CHART_BARS},
    ),
)
query(
    "land_chart_splits",
    lambda s, sf: landing.chart_splits(_chart_payloads(s, sf)),
    "instrument_key execution_date:s split_ratio",
    with_tables("SELECT * FROM splits", "splits"),
)
query(
    "land_chart_dividends",
    lambda s, sf: landing.chart_dividends(_chart_payloads(s, sf)),
    "instrument_key ex_dividend_date:s amount",
    with_tables("SELECT * FROM dividends", "dividends"),
)


def _texts(rows, dates):
    return rows.withColumns({c: F.col(c).cast("string") for c in dates})


query(
    "land_contracts",
    lambda s, sf: landing.contract_rows(
        _results(
            _texts(d.contracts(s, sf), ["first_trade_date", "last_trade_date",
                                        "settlement_date", "date"]),
            ["product_code"],
            F.struct(*d.contracts(s, sf).columns),
        )
    ),
    "product_code ticker first_trade_date:s last_trade_date:s settlement_date:s date:s "
    "trade_tick_size:4 name type active",
    with_tables("SELECT * FROM all_contracts", "all_contracts"),
)
query(
    "land_vendor_splits",
    lambda s, sf: landing.vendor_splits(
        _results(
            split_factors(d.splits(s, sf)),
            ["instrument_key"],
            F.struct(
                F.substring_index("instrument_key", ":", -1).alias("ticker"),
                F.col("execution_date").cast("string").alias("execution_date"),
                "historical_adjustment_factor",
                F.lit("forward_split").alias("adjustment_type"),
                F.lit(1).alias("split_from"),
                F.col("split_ratio").cast("bigint").alias("split_to"),
            ),
        )
    ),
    "instrument_key ticker execution_date:s historical_adjustment_factor:10 adjustment_type "
    "split_from split_to",
    with_tables(
        "SELECT *, substr(instrument_key, 8) AS ticker, 'forward_split' AS adjustment_type,"
        " factor AS historical_adjustment_factor, 1 AS split_from,"
        " CAST(split_ratio AS BIGINT) AS split_to FROM sf",
        "sf",
    ),
)
query(
    "land_vendor_dividends",
    lambda s, sf: landing.vendor_dividends(
        _results(
            d.dividends(s, sf),
            ["instrument_key"],
            F.struct(
                F.substring_index("instrument_key", ":", -1).alias("ticker"),
                F.col("ex_dividend_date").cast("string").alias("ex_dividend_date"),
                F.date_add("ex_dividend_date", 14).cast("string").alias("pay_date"),
                F.col("amount").alias("cash_amount"),
                F.lit("USD").alias("currency"),
                F.lit(4).alias("frequency"),
            ),
        )
    ),
    "instrument_key ticker ex_dividend_date:s pay_date:s record_date:s cash_amount currency "
    "frequency",
    with_tables(
        "SELECT *, substr(instrument_key, 8) AS ticker, ex_dividend_date + 14 AS pay_date,"
        " NULL AS record_date, amount AS cash_amount, 'USD' AS currency, 4 AS frequency"
        " FROM dividends",
        "dividends",
    ),
)
query(
    "land_tickers",
    lambda s, sf: landing.ticker_rows(d.tickers(s, sf)),
    "ticker name market locale type active primary_exchange currency_name cik delisted_utc",
    with_tables("SELECT *, NULL AS cik, NULL AS delisted_utc FROM tickers", "tickers"),
)
query(
    "land_ticker_types",
    lambda s, sf: landing.ticker_type_rows(d.ticker_types(s, sf).drop("locale")),
    "code description asset_class locale",
    with_tables(
        "SELECT * REPLACE (NULL AS locale, CASE asset_class WHEN 'fx' THEN 'FX'"
        " ELSE asset_class END AS asset_class) FROM ticker_types",
        "ticker_types",
    ),
)

# --- stored tables --------------------------------------------------------------------------


def _saved_runs(s, sf):
    """Both loads saved as raw runs; the second lacks an optional column."""
    root = scratch_path(s, "raw-runs")
    runs = materialize(d.runs(s, sf), "runs")
    store.save_run(runs.filter("run_id = '20240201T000000'"), root, "20240201T000000")
    late = runs.filter("run_id = '20240208T000000'").drop("dollar_volume")
    store.save_run(late, root, "20240208T000000")
    return root


def _stored_bars(s, sf):
    root = scratch_path(s, "bars")
    store.write_bars(merge_runs(store.read_runs(s, _saved_runs(s, sf))), root)
    return root


query(
    "read_all_runs",
    lambda s, sf: store.read_runs(s, _saved_runs(s, sf)),
    f"instrument_key product_code ticker window_start:s {OHLC} volume dollar_volume:2 run_id",
    with_tables(
        "SELECT * REPLACE (CASE WHEN run_id < '20240205' THEN dollar_volume END"
        " AS dollar_volume), symbol AS product_code FROM runs",
        "runs",
    ),
)


def _differing_runs(s, sf):
    """Both loads as other programs left them: columns of other types, one without a volume."""
    root = scratch_path(s, "foreign-runs")
    rows = store.with_month(d.runs(s, sf)).drop("product_code", "instrument_key")
    early = F.col("run_id") == "20240201T000000"
    fx = F.col("instrument_type") == "forex"
    for part in (
        rows.filter(early).withColumn("volume", F.col("volume").cast("int")),
        rows.filter(~early & ~fx).withColumn("volume", F.col("volume").cast("double")),
        rows.filter(~early & fx).drop("volume"),
    ):
        part.write.mode("append").partitionBy(
            "run_id", "instrument_type", "resolution", "month"
        ).parquet(root)
    return root


query(
    "read_widened_runs",
    lambda s, sf: read_widened_runs(s, _differing_runs(s, sf)),
    f"run_id instrument_type symbol ticker window_start:s {OHLC} volume:2",
    with_tables(
        "SELECT * REPLACE (CASE WHEN run_id < '20240205' OR instrument_type <> 'forex'"
        " THEN CAST(volume AS DOUBLE) END AS volume) FROM runs",
        "runs",
    ),
)
# What follows reads the manifests of the two tables, not their bars.


def _run_catalog(s, sf):
    return manifest.run_catalog(store.run_log(s, _saved_runs(s, sf)))


query(
    "catalog_of_stored_runs",
    _run_catalog,
    "instrument_key ticker resolution run_id row_count window_start_min:s window_start_max:s",
    with_tables("SELECT * FROM catalog", "catalog"),
)
query(
    "overview_of_stored_runs",
    lambda s, sf: planning.run_overview(_run_catalog(s, sf), "2024-02-08"),
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
    "skip_stored_runs",
    lambda s, sf: planning.skip_loaded(
        d.instruments(s, sf).select(
            "instrument_key", F.col("symbol").alias("ticker"), F.lit("1min").alias("resolution")
        ),
        _run_catalog(s, sf),
        "2024-02-08",
    ),
    "instrument_key ticker resolution",
    with_tables(
        """
        SELECT instrument_key, symbol AS ticker, '1min' AS resolution FROM instruments
        WHERE NOT EXISTS (SELECT 1 FROM catalog c
                          WHERE c.instrument_key = instruments.instrument_key
                            AND c.ticker = symbol AND run_id LIKE '20240208%')
        """,
        "instruments",
        "catalog",
    ),
)
query(
    "coverage_of_stored_bars",
    lambda s, sf: with_lag(
        manifest.held_rows(store.bars_log(s, _stored_bars(s, sf))), "2024-02-03"
    ),
    "instrument_key resolution rows min_date:s max_date:s lag_days",
    with_tables(
        "SELECT instrument_key, '1min' AS resolution, count(*) AS rows,"
        " CAST(min(window_start) AS DATE) AS min_date, CAST(max(window_start) AS DATE) AS max_date,"
        " DATE '2024-02-03' - CAST(max(window_start) AS DATE) AS lag_days FROM merged GROUP BY 1",
        "merged",
    ),
)


def _weeks_of_stored_bars(s, sf):
    """Weekly bars of a stored table; first and last sessions come from its manifest."""
    root = scratch_path(s, "bars")
    store.write_bars(d.daily_bars(s, sf), root)
    bounds = manifest.session_bounds(store.bars_log(s, root))
    return resample_days(store.read_bars(s, root), 7, week_aligned=True, bounds=bounds)


query(
    "weekly_bars_of_stored_table",
    _weeks_of_stored_bars,
    f"instrument_key window_start:s {OHLC} session_end_date:s candle_count volume transactions",
    with_tables(sql.days("db", 7, True), "db"),
)
query(
    "read_merged_bars",
    lambda s, sf: store.read_bars(
        s, _stored_bars(s, sf), instrument_type="futures", symbols=["CLICK", "VIEW"],
        resolution="1min",
    ),
    f"instrument_key ticker window_start:s {OHLC} volume run_id",
    with_tables("SELECT * FROM merged WHERE symbol IN ('CLICK', 'VIEW')", "merged"),
)
def _manifest(s, sf):
    runs, bars = _saved_runs(s, sf), scratch_path(s, "bars")
    store.write_bars(merge_runs(store.read_runs(s, runs)), bars)
    return store.stored_manifest(s, runs, bars, fetched_at="2024-02-08T00:00:00")


query(
    "manifest",
    _manifest,
    "instrument_key resolution row_count source source_run_count duplicates_removed "
    "window_start_min:s window_start_max:s last_fetched_at",
    with_tables(
        """
        SELECT instrument_key, resolution, 'minute' AS source,
               count(*) FILTER (rk = 1) AS row_count,
               count(DISTINCT run_id) FILTER (rk = 1) AS source_run_count,
               min(window_start) FILTER (rk = 1) AS window_start_min,
               max(window_start) FILTER (rk = 1) AS window_start_max,
               count(*) FILTER (rk > 1) AS duplicates_removed,
               '2024-02-08T00:00:00' AS last_fetched_at
        FROM ranked GROUP BY 1, 2
        """,
        "ranked",
    ),
)
query(
    "column_manifest",
    lambda s, sf: store.column_manifest(d.minute_bars(s, sf)),
    "column non_null dtype",
    with_tables(
        """
        SELECT unnest(['instrument_key', 'instrument_type', 'symbol', 'resolution', 'ticker',
                       'window_start', 'session_end_date', 'open', 'high', 'low', 'close',
                       'volume', 'transactions', 'dollar_volume', 'product_code']) AS "column",
               unnest([count(instrument_key), count(instrument_type), count(symbol),
                       count(resolution), count(ticker), count(window_start),
                       count(session_end_date), count(open), count(high), count(low),
                       count(close), count(volume), count(transactions), count(dollar_volume),
                       count(symbol)]) AS non_null,
               unnest(['string', 'string', 'string', 'string', 'string', 'timestamp_ntz', 'date',
                       'double', 'double', 'double', 'double', 'bigint', 'bigint', 'double',
                       'string']) AS dtype
        FROM mb
        """,
        "mb",
    ),
)


query(
    "query_latest_page_30m",
    lambda s, sf: query_latest_page(s, _stored_bars(s, sf), BarQuery("30min"), 20),
    f"instrument_key window_start:s {OHLC} session_end_date:s candle_count ticker volume",
    with_tables(
        f"SELECT * FROM ({sql.minutes('merged', 30)}) QUALIFY row_number() OVER"
        " (PARTITION BY instrument_key ORDER BY window_start DESC) <= 20",
        "merged",
    ),
)


def _exported(s, sf):
    """Daily bars, all columns, exported as CSV and read again."""
    path = scratch_path(s, "export") + ".csv"
    rows = d.daily_bars(s, sf)
    store.export_frame(rows, path)
    return s.read.option("header", True).schema(rows.schema).csv(path)


query(
    "export_csv",
    _exported,
    f"instrument_key instrument_type symbol resolution window_start:s session_end_date:s ticker {OHLC} "
    "volume transactions",
    with_tables("SELECT * FROM db", "db"),
)


def _shard_root(s, sf):
    root = scratch_path(s, "tickers")
    shards.write_tickers(landing.ticker_rows(d.tickers(s, sf)), root)
    return root


query(
    "read_ticker_shards",
    lambda s, sf: shards.read_tickers(
        s, _shard_root(s, sf), markets=["fx", "indices", "stocks"], active=True
    ),
    "ticker name market active type",
    with_tables(
        "SELECT * FROM tickers WHERE market IN ('fx', 'indices', 'stocks') AND active", "tickers"
    ),
)
query(
    "ticker_inventory",
    lambda s, sf: shards.inventory(shards.read_tickers(s, _shard_root(s, sf))),
    "market active row_count",
    with_tables(
        "SELECT market, active, count(*) AS row_count FROM tickers GROUP BY 1, 2", "tickers"
    ),
)

# --- overlays -------------------------------------------------------------------------------

query(
    "list_overlays",
    lambda s, sf: overlays.list_overlays(d.overlay_tables(s, sf)[0], "stocks:F").withColumn(
        "ids", F.array_join("ids", ",")
    ),
    "stem instrument ids default_id",
    """
    SELECT stem, 'stocks:F' AS instrument, string_agg(id, ',' ORDER BY first, id) AS ids,
           arg_min(id, (first, id)) AS default_id
    FROM (SELECT 'run-' || strftime(o_orderdate, '%Y-%m') AS stem,
                 'bt-' || substr(o_orderpriority, 1, 1) AS id, min(o_orderkey) AS first
          FROM orders GROUP BY 1, 2)
    JOIN (SELECT 'run-' || strftime(o_orderdate, '%Y-%m') AS stem,
                 arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) USING (stem)
    WHERE status IN ('O', 'F') GROUP BY stem
    UNION ALL
    SELECT DISTINCT 'empty-' || year(o_orderdate), 'stocks:F', 'empty-' || year(o_orderdate),
           'empty-' || year(o_orderdate) FROM orders
    """,
)
query(
    "overlay_transactions",
    lambda s, sf: overlays.load_transactions(d.overlay_tables(s, sf)[1], "bt-2"),
    "backtest_id time price:2 side kind",
    """
    SELECT 'bt-2' AS backtest_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN o_orderkey % 3 = 0 THEN '.500000Z' ELSE 'Z' END AS time,
           o_totalprice AS price, CASE o_orderstatus WHEN 'F' THEN 'sell' ELSE 'buy' END AS side,
           o_orderstatus AS kind
    FROM orders WHERE o_orderpriority LIKE '2%'
    """,
)
query(
    "overlay_orders",
    lambda s, sf: overlays.load_orders(d.overlay_tables(s, sf)[2], "bt-5"),
    "backtest_id time_from time_to price:2 side order_type",
    """
    SELECT 'bt-5' AS backtest_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS time_from,
           strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%SZ') AS time_to,
           o_totalprice AS price, CASE o_orderstatus WHEN 'F' THEN 'sell' ELSE 'buy' END AS side,
           'limit' AS order_type
    FROM orders WHERE o_orderpriority LIKE '5%'
    """,
)

# --- streams --------------------------------------------------------------------------------


def _stream_merged(s, sf):
    """Each load is merged when it lands; the second start takes up where the first stopped."""
    landing_root, bars_root = scratch_path(s, "raw-runs"), scratch_path(s, "stream-bars")
    checkpoint = scratch_path(s, "checkpoint")
    runs = materialize(d.runs(s, sf), "runs")
    for run_id in ("20240201T000000", "20240208T000000"):
        store.save_run(runs.filter(F.col("run_id") == run_id), landing_root, run_id)
        start_merge(landed_runs(s, landing_root), bars_root, checkpoint).awaitTermination()
    return store.read_bars(s, bars_root)


query(
    "stream_merge_runs",
    _stream_merged,
    f"instrument_key ticker window_start:s {OHLC} volume transactions run_id",
    with_tables("SELECT * FROM merged", "merged"),
)


def _stream_bars(s, sf):
    """30-minute bars kept up to date from the stream of raw runs, open windows included."""
    bars_root, out = scratch_path(s, "stream-bars"), scratch_path(s, "stream-sink")
    checkpoint = scratch_path(s, "checkpoint")
    runs = landed_runs(s, _saved_runs(s, sf))
    start_bars(runs, bars_root, out, 30, checkpoint).awaitTermination()
    return s.read.parquet(out)


query(
    "stream_bars_30m",
    _stream_bars,
    f"instrument_key window_start:s {OHLC} candle_count volume transactions",
    with_tables(
        """
        SELECT instrument_key, time_bucket(INTERVAL 30 MINUTE, window_start) AS window_start,
               arg_min(open, window_start) AS open, max(high) AS high, min(low) AS low,
               arg_max(close, window_start) AS close, CAST(count(*) AS INTEGER) AS candle_count,
               CAST(sum(volume) AS BIGINT) AS volume,
               CAST(sum(transactions) AS BIGINT) AS transactions
        FROM merged GROUP BY 1, 2
        """,
        "merged",
    ),
)


def _stream_sessions(s, sf):
    """Session-anchored bars from the stream of raw runs, one run file after the other."""
    own, out = stateful_session(s), scratch_path(s, "stream-sessions")
    runs = landed_runs(own, _saved_runs(s, sf), 2)
    # the second run corrects minutes of the whole month
    start_session_bars(runs, out, 30, scratch_path(s, "checkpoint"), "60 days").awaitTermination()
    return session_bars_view(s, out)


query(
    "stream_session_bars_30m",
    _stream_sessions,
    f"instrument_key window_start:s {OHLC} session_end_date:s candle_count ticker volume"
    " transactions",
    with_tables(sql.minutes("merged", 30), "merged"),
)


def _stream_freshness(s, sf):
    own, checkpoint = stateful_session(s), scratch_path(s, "checkpoint")
    runs = landed_runs(own, _saved_runs(s, sf))
    monitor = start_monitor(
        runs, scratch_path(s, "alerts"), checkpoint, processingTime="1 second"
    )
    try:
        wait_until_drained(monitor)
    finally:
        monitor.stop()
    return freshness_view(own, checkpoint, "2024-02-03")


query(
    "stream_freshness",
    _stream_freshness,
    "instrument_key resolution latest:s rows_seen lag_days",
    with_tables(
        "SELECT instrument_key, resolution, max(window_start) AS latest,"
        " count(*) AS rows_seen, DATE '2024-02-03' - CAST(max(window_start) AS DATE) AS lag_days"
        " FROM runs GROUP BY 1, 2",
        "runs",
    ),
)
