import pytest
from helpers import day
from pyspark.sql import functions as F

from barloom.operators.roll import (
    active_contract,
    adjust_rolls,
    dedupe_timestamps,
    overlapping_segments,
    roll_chain,
    tick_sizes,
)
from barloom.operators.ticks import DataQualityError, assert_quality, normalize_ticks, tick_quality


@pytest.fixture(scope="module")
def chain(contracts):
    return roll_chain(contracts)


def _es(make_bars, ticker, *points):
    return make_bars(list(points), kind="futures", symbol="ES", ticker=ticker)


def test_chain(chain):
    rows = chain.orderBy("roll_rank").collect()
    assert [r.ticker for r in rows] == ["ESH5", "ESM5", "ESU5"]
    assert [r.rollover_date.isoformat() for r in rows] == ["2025-03-07", "2025-06-06", "2025-09-05"]
    assert [r.active_from.isoformat() for r in rows] == ["2024-12-16", "2025-03-07", "2025-06-06"]


@pytest.mark.parametrize(
    ("on", "ticker"),
    [("2025-01-15", "ESH5"), ("2025-04-15", "ESM5"), ("2025-06-06", "ESU5"),
     ("2024-01-01", "ESH5"), ("2026-01-01", "ESU5")],
)
def test_active_contract(spark, chain, on, ticker):
    request = spark.createDataFrame([("futures:ES", day(on))], "instrument_key string, day date")
    assert active_contract(request, chain).first().active_ticker == ticker


def test_no_chain_no_contract(spark, chain):
    request = spark.createDataFrame([("futures:XX", day("2025-01-01"))],
                                    "instrument_key string, day date")
    assert active_contract(request, chain).first().active_ticker is None


def test_overlap(spark, chain):
    request = spark.createDataFrame(
        [("futures:ES", day("2025-03-07"), day("2025-06-05"))],
        "instrument_key string, start_date date, end_date date",
    )
    assert [r.ticker for r in overlapping_segments(request, chain).collect()] == ["ESM5"]


def test_unknown_ticker_has_no_tick(spark, chain):
    rows = spark.createDataFrame([("futures:ES", "ESM5"), ("futures:ES", "ZZZ")],
                                 "instrument_key string, ticker string")
    assert {r.ticker: r.tick_size for r in tick_sizes(rows, chain).collect()} == {
        "ESM5": 0.25, "ZZZ": 0.0
    }


def test_newest_contract_wins_on_the_roll_day(make_bars, chain):
    bars = _es(make_bars, "ESH5", ("2025-03-07 00:00", 5800)).unionByName(
        _es(make_bars, "ESM5", ("2025-03-07 00:00", 5810))
    )
    rows = dedupe_timestamps(bars, chain).collect()
    assert [(r.ticker, r.open) for r in rows] == [("ESM5", 5810.0)]


def test_roll_adjustment(make_bars, chain):
    old = _es(make_bars, "ESH5", ("2025-03-05 10:00", 99.5), ("2025-03-06 10:00", 199.5),
              ("2025-03-07 10:00", 7.0))
    new = _es(make_bars, "ESM5", ("2025-03-06 10:00", 7.0), ("2025-03-07 10:00", 219.5))
    other = _es(make_bars, "ODD", ("2025-03-05 10:00", 50.0))
    out = adjust_rolls(old.unionByName(new).unionByName(other), chain)
    closes = {(r.ticker, r.window_start.day): r.close for r in out.collect()}
    assert closes[("ESH5", 5)] == pytest.approx(100 * 1.1)
    assert closes[("ESH5", 6)] == pytest.approx(220.0)
    assert closes[("ESM5", 7)] == 220.0
    assert closes[("ODD", 5)] == 50.5


def test_roll_without_new_prices_is_ignored(make_bars, chain):
    bars = _es(make_bars, "ESH5", ("2025-03-05 10:00", 99.5))
    assert adjust_rolls(bars, chain).first().close == 100.0


def test_prices_in_ticks(make_bars, chain):
    row = normalize_ticks(_es(make_bars, "ESM5", ("2025-04-01 10:00", 4499.75)), chain).first()
    assert row.close == 18001
    odd = normalize_ticks(_es(make_bars, "ODD", ("2025-04-01 10:00", 4499.75)), chain).first()
    assert (odd.open, odd.close) == (4499, 4500)


def test_quality(make_bars, chain):
    clean = _es(make_bars, "ESM5", *[(f"2025-04-01 10:0{i}", 4500.25 + i) for i in range(3)])
    report = tick_quality(clean, chain, 0.1)
    assert {r.status for r in report.collect()} == {"OK"}
    assert_quality(report)
    one_bad = clean.withColumn(
        "open", F.when(F.minute("window_start") == 1, 4501.27).otherwise(F.col("open"))
    )
    report = tick_quality(one_bad, chain, 0.1)
    per_ticker = report.filter("ticker IS NOT NULL").first()
    assert (per_ticker.bad_candles, per_ticker.total_candles, per_ticker.status) == (1, 3, "ERREUR")
    with pytest.raises(DataQualityError):
        assert_quality(report)
    off = _es(make_bars, "ESM5", ("2025-04-01 10:00", 1.11), ("2025-04-01 10:01", 1.12))
    total = tick_quality(off, chain, 0.1).filter("ticker IS NULL").first()
    assert (total.bad_candles, total.total_candles) == (2, 2)
