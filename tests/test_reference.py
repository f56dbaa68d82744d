"""Coverage, planning, ticker reference, landed payloads and overlays."""

import json

import pytest
from helpers import at, day
from pyspark.sql import functions as F

from barloom.functions import bound, clock_seconds, daily_vendor_ticker
from barloom.operators import coverage, filters, planning, summary, tickers
from barloom.operators.adjust import split_factors
from barloom.operators.roll import roll_chain
from barloom.sources import landing, overlays

TODAY = "2024-02-10"


@pytest.fixture(scope="module")
def instruments(spark):
    rows = [("stocks", "AAA"), ("stocks", "OLD"), ("futures", "ES"), ("options", "OPT"),
            ("forex", "EURUSD")]
    return spark.createDataFrame(rows, "instrument_type string, symbol string").withColumn(
        "instrument_key", F.concat_ws(":", "instrument_type", "symbol")
    )


@pytest.fixture(scope="module")
def bars(make_bars):
    return (
        make_bars([("2024-02-07 10:00", 1), ("2024-02-01 10:00", 1)], symbol="AAA")
        .unionByName(make_bars([("2024-01-26 00:00", 1)], symbol="AAA", resolution="1day"))
        .unionByName(make_bars([("2024-02-06 10:00", 1)], symbol="OLD"))
        .unionByName(make_bars([("2024-02-05 00:00", 1)], symbol="OLD", resolution="1day"))
    )


def test_health(bars, instruments):
    held = coverage.coverage(bars, TODAY)
    assert {(r.instrument_key, r.resolution): (r.lag_days, r.stale) for r in held.collect()} == {
        ("stocks:AAA", "1min"): (3, False), ("stocks:AAA", "1day"): (15, True),
        ("stocks:OLD", "1min"): (4, True), ("stocks:OLD", "1day"): (5, False),
    }
    issues = coverage.health_issues(instruments, held)
    found = {(r.instrument_key, r.code, r.resolution) for r in issues.collect()}
    assert ("stocks:AAA", "stale", "1day") in found
    assert ("stocks:AAA", "cross_resolution_lag", None) in found
    assert ("options:OPT", "missing_aggregate", "1min") in found
    assert ("options:OPT", "missing_aggregate", "1day") not in found
    health = {r.instrument_key: r for r in
              coverage.instrument_health(instruments, issues).collect()}
    assert health["stocks:AAA"].worst_level == "stale" and health["stocks:AAA"].fails_check
    assert health["forex:EURUSD"].worst_level == "warn"
    assert not health["forex:EURUSD"].fails_check
    assert health["forex:EURUSD"].fails_strict_check


def test_load_plans(spark, bars, instruments, contracts):
    held = coverage.coverage(bars, TODAY)
    plan = {r.ticker: (str(r.load_from), str(r.load_to))
            for r in planning.single_load_plan(instruments, held, TODAY).collect()}
    assert plan == {"AAA": ("2024-02-06", TODAY), "OLD": ("2024-02-05", TODAY),
                    "EURUSD": ("2022-02-20", TODAY)}
    daily = {r.ticker: str(r.load_from)
             for r in planning.single_load_plan(instruments, held, TODAY, "1day").collect()}
    assert daily == {"AAA": "2024-01-21", "OLD": "2024-01-31", "ES": "None", "EURUSD": "None"}
    chain = roll_chain(contracts)
    rolls = {r.ticker: (str(r.load_from), str(r.load_to)) for r in
             planning.futures_load_plan(instruments, chain, held, "2025-04-01").collect()}
    assert rolls == {"ESH5": ("2024-12-16", "2025-03-07"), "ESM5": ("2025-03-07", "2025-04-01")}


def test_runs(spark, bars):
    runs = bars.withColumn("run_id", F.lit("20240210T060000"))
    catalog = planning.run_catalog(runs)
    row = planning.run_overview(catalog, TODAY).filter(
        "instrument_key = 'stocks:AAA' AND resolution = '1min'"
    ).first()
    assert (row.run_count, row.latest_run_date, row.done_today) == (1, "20240210", True)
    plan = spark.createDataFrame(
        [("stocks:AAA", "AAA", "1min"), ("stocks:NEW", "NEW", "1min")],
        "instrument_key string, ticker string, resolution string",
    )
    assert [r.ticker for r in planning.skip_loaded(plan, catalog, TODAY).collect()] == ["NEW"]
    assert planning.skip_loaded(plan, catalog, "2024-02-11").count() == 2


def test_freshness(spark):
    rows = [("a", "2024-02-09T12:00:00"), ("b", "2024-02-09T12:00:01+00:00"), ("c", "bad"),
            ("d", None)]
    manifest = spark.createDataFrame(rows, "name string, last_fetched_at string")

    def fresh(**how):
        out = planning.freshness(manifest, "2024-02-10T12:00:00", 1, **how)
        return {r.name for r in out.filter("is_fresh").collect()}

    assert fresh() == {"b"}
    assert fresh(inclusive=True) == {"a", "b"}


def test_snapshot_dates(spark):
    products = spark.createDataFrame([("ES",)], "product_code string")
    dates = planning.snapshot_dates(products, "2024-12-31", interval_months=12)
    assert sorted(str(r.snapshot_date) for r in dates.collect()) == [
        "2023-01-11", "2024-01-06", "2024-12-31"
    ]
    assert planning.snapshot_dates(products, "2024-12-31", interval_months=0).count() == 1


def test_resolution_of_requests(spark, instruments):
    twice = instruments.unionByName(
        spark.createDataFrame([("indices", "ES", "indices:ES")],
                              "instrument_type string, symbol string, instrument_key string")
    )
    requests = spark.createDataFrame([(r,) for r in ("AAA", "ES", "futures:ES", "NOPE")],
                                     "request string")
    out = {r.request: (r.status, r.instrument_key)
           for r in filters.resolve_instruments(requests, twice).collect()}
    assert out == {"AAA": ("ok", "stocks:AAA"), "ES": ("ambiguous", None),
                   "futures:ES": ("ok", "futures:ES"), "NOPE": ("unknown", None)}


def test_bounds(spark):
    rows = spark.createDataFrame([("2024-01-05",), ("2024-01-05T10:00:00+02:00",)], "t string")
    out = rows.select(bound(F.col("t")).alias("a"), bound(F.col("t"), is_end=True).alias("b"))
    got = [tuple(r) for r in out.collect()]
    assert got == [(at("2024-01-05"), at("2024-01-05 23:59:59.999999")),
                   (at("2024-01-05 08:00"), at("2024-01-05 08:00"))]
    assert clock_seconds("09:30") == 34200
    with pytest.raises(ValueError):
        clock_seconds("25:00")


def test_performance_needs_two_points(make_bars):
    bars = make_bars([("2024-02-01 00:00", 99.5), ("2024-02-05 00:00", 109.5)],
                     resolution="1day").unionByName(
        make_bars([("2024-02-05 00:00", 1)], symbol="ONE", resolution="1day"))
    out = {r.instrument_key: r for r in summary.window_performance(bars, TODAY, 30).collect()}
    assert out["stocks:AAA"].performance_pct == pytest.approx(10.0)
    assert out["stocks:AAA"].closes == [100.0, 110.0]
    assert out["stocks:ONE"].performance_pct is None


# --- ticker reference -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def listing(spark):
    rows = [("AAPL", "Apple Inc.", "stocks", "CS", True, "XNAS", "usd"),
            ("MSFT", "Microsoft Corp", "stocks", "CS", True, "XNAS", "usd"),
            ("EURUSD", "Euro - Dollar", "fx", "", True, None, "usd"),
            ("I:NDX", "Nasdaq 100", "indices", None, True, None, "usd"),
            ("BTCUSD", "Bitcoin", "crypto", "CC", False, None, ""),
            ("ES", "Eversource", "stocks", "CS", True, "XNYS", "usd")]
    return spark.createDataFrame(
        rows, "ticker string, name string, market string, type string, active boolean, "
        "primary_exchange string, currency_name string"
    )


def _found(df):
    return [r.ticker for r in df.collect()]


def test_search(listing):
    search = tickers.search_tickers
    assert _found(search(listing, query="APPLE")) == ["AAPL"]
    assert _found(search(listing, query=".")) == ["AAPL"]
    assert _found(search(listing, ticker="c:eurusd")) == ["EURUSD"]
    assert _found(search(listing, ticker="I:NDX")) == []
    assert _found(search(listing, markets=["FX", "crypto"])) == ["BTCUSD", "EURUSD"]
    assert _found(search(listing, ticker_type="cs", exchange="xnas", limit=1)) == ["AAPL"]
    assert _found(search(listing, active=False)) == ["BTCUSD"]


def test_distinct_values(listing):
    out = {(r.column, r.value): r["count"] for r in summary.distinct_values(listing).collect()}
    assert out[("market", "stocks")] == 3
    assert ("type", "") not in out


def test_instrument_mapping(listing):
    keys = {r.instrument_key for r in tickers.to_instruments(listing).collect()}
    assert keys == {"stocks:AAPL", "stocks:MSFT", "stocks:ES", "forex:EURUSD", "indices:NDX"}


@pytest.mark.parametrize(
    ("kind", "symbol", "daily"),
    [("stocks", "BRK.A", "BRK-A"), ("stocks", "ABC.WS", None), ("stocks", "ABC-U", None),
     ("stocks", "ABC.P", None), ("forex", "eurusd", "EURUSD=X"), ("forex", "EURUSD=X", "EURUSD=X"),
     ("indices", "NDX", "^NDX"), ("futures", "ES", "ES=F"), ("options", "X", None)],
)
def test_daily_vendor_symbols(spark, kind, symbol, daily):
    row = spark.range(1).select(daily_vendor_ticker(F.lit(kind), F.lit(symbol)).alias("t")).first()
    assert row.t == daily


def test_overrides_win(spark, instruments):
    overrides = spark.createDataFrame([("OPT", "OPT.X"), ("stocks:AAA", "ZZZ")],
                                      "name string, daily_ticker string")
    out = {r.symbol: r.daily_ticker
           for r in tickers.vendor_symbols(instruments, overrides).collect()}
    assert out["OPT"] == "OPT.X" and out["AAA"] == "ZZZ" and out["OLD"] == "OLD"


def test_display_names(spark, listing, contracts, instruments):
    extra = spark.createDataFrame(
        [("stocks", "AAPL", "stocks:AAPL"), ("forex", "ES", "forex:ES"),
         ("futures", "NQ", "futures:NQ")],
        "instrument_type string, symbol string, instrument_key string",
    )
    wanted = instruments.unionByName(extra)
    names = {r.instrument_key: r.name
             for r in tickers.display_names(wanted, listing, contracts).collect()}
    assert names["stocks:AAPL"] == "Apple Inc."
    assert names["forex:ES"] == "ES"
    assert names["futures:ES"] == "Eversource"
    assert names["futures:NQ"] == "NQ"
    strict = tickers.display_names(wanted, listing, contracts, any_market_for_futures=False)
    names = {r.instrument_key: r.name for r in strict.collect()}
    assert names["futures:ES"] == "ES Future"


# --- landed payloads ------------------------------------------------------------------------


def test_futures_payload(spark):
    payload = json.dumps({"results": [
        {"ticker": "ESM5", "window_start": 1748770200000000000, "session_end_date": "2025-06-01",
         "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 7},
        {"ticker": "ESM5", "window_start": "1748770260000000000", "session_end_date": "2025-06-01",
         "close": 1.5}]})
    rows = landing.futures_bars(
        spark.createDataFrame([("ES", payload)], "product_code string, payload string")
    ).orderBy("window_start").collect()
    assert [r.window_start for r in rows] == [at("2025-06-01 09:30"), at("2025-06-01 09:31")]
    assert rows[0].instrument_key == "futures:ES"
    assert rows[0].session_end_date == day("2025-06-01")


def test_index_payload_without_volume(spark):
    payload = json.dumps({"results": [{"o": 1, "h": 2, "l": 0, "c": 1, "t": 1720000000000}]})
    row = landing.v2_bars(
        spark.createDataFrame([("indices", "NDX", payload)],
                              "instrument_type string, symbol string, payload string")
    ).first()
    assert row.volume is None and row.dollar_volume is None
    assert row.session_end_date == day("2024-07-03")


def _chart(spark, result):
    payload = json.dumps({"chart": {"result": result}})
    return spark.createDataFrame([("stocks:AAA", "AAA", payload)],
                                 "instrument_key string, symbol string, payload string")


def test_chart_payload(spark):
    quote = {"open": [1, None, 3], "high": [1, 2, 3], "low": [1, 2, 3], "close": [1.5, 2, 3],
             "volume": [None, 5, 6]}
    events = {
        "splits": {
            "a": {"date": 1598832000, "numerator": 4, "denominator": 1, "splitRatio": "4:1"},
            "b": {"date": 1598832000, "splitRatio": "3:2"},
            "c": {"date": 1598832000, "numerator": 0, "denominator": 1},
            "d": {"date": 1598832000, "splitRatio": "x:y"},
            "e": {"numerator": 2, "denominator": 1},
        },
        "dividends": {"a": {"date": 1598832000, "amount": 0.5}, "b": {"date": 1598832000}},
    }
    payloads = _chart(spark, [{"timestamp": [1598621400, 1598880600, 1598967000],
                               "indicators": {"quote": [quote]}, "events": events}])
    bars = landing.chart_bars(payloads).orderBy("window_start").collect()
    assert [(str(r.session_end_date), r.close, r.volume) for r in bars] == [
        ("2020-08-28", 1.5, 0), ("2020-09-01", 3.0, 6)
    ]
    assert sorted(r.split_ratio for r in landing.chart_splits(payloads).collect()) == [1.5, 4.0]
    assert [r.amount for r in landing.chart_dividends(payloads).collect()] == [0.5]
    splits = spark.createDataFrame([("stocks:AAA", day("2020-08-31"), 4.0)],
                                   "instrument_key string, execution_date date, split_ratio double")
    raw = landing.daily_raw_bars(payloads, split_factors(splits)).orderBy("window_start").collect()
    assert [r.close for r in raw] == [6.0, 3.0]


def test_empty_chart(spark):
    for result in (None, []):
        assert landing.chart_bars(_chart(spark, result)).count() == 0
        assert landing.chart_splits(_chart(spark, result)).count() == 0


def test_listing_columns(spark):
    rows = spark.createDataFrame([("A", "YES"), ("B", "no"), ("C", None)],
                                 "ticker string, active string")
    out = landing.ticker_rows(rows)
    assert len(out.columns) == 16
    assert [r.active for r in out.orderBy("ticker").collect()] == [True, False, None]


def test_overlays(spark):
    rows = spark.createDataFrame(
        [("b1", at("2024-01-02 03:04:05"), 1.0, "buy", "entry"),
         ("b2", at("2024-01-02 03:04:05"), 2.0, "buy", "entry")],
        "backtest_id string, time timestamp_ntz, price double, side string, kind string",
    )
    out = overlays.load_transactions(rows, "b1").collect()
    assert [(r.time, r.price) for r in out] == [("2024-01-02T03:04:05Z", 1.0)]
