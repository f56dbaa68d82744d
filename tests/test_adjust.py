import pytest
from helpers import day

from barloom.operators.adjust import (
    adjust_dividends,
    adjust_splits,
    dividend_factors,
    split_factors,
    unadjust_splits,
)

SPLITS = "instrument_key string, execution_date date, historical_adjustment_factor double"
RATIOS = "instrument_key string, execution_date date, split_ratio double"
DIVIDENDS = "instrument_key string, ex_dividend_date date, amount double"


def _closes(df):
    return [round(r.close, 9) for r in df.orderBy("window_start").collect()]


def _daily(make_bars, *points):
    return make_bars([(f"{d} 00:00", c - 0.5) for d, c in points], resolution="1day")


def test_first_split_after_the_bar_applies(spark, make_bars):
    splits = spark.createDataFrame(
        [("stocks:AAA", day("2020-08-28"), 0.25), ("stocks:BBB", day("2020-08-28"), 0.5)], SPLITS
    )
    bars = _daily(make_bars, ("2020-08-27", 400), ("2020-08-28", 100), ("2020-08-29", 101))
    out = adjust_splits(bars, splits)
    assert _closes(out) == [100.0, 100.0, 101.0]
    assert [r.volume for r in out.collect()] == [100, 100, 100]


def test_zero_factor_and_missing_actions_change_nothing(spark, make_bars):
    bars = _daily(make_bars, ("2020-08-27", 400))
    zero = spark.createDataFrame([("stocks:AAA", day("2020-08-28"), 0.0)], SPLITS)
    assert _closes(adjust_splits(bars, zero)) == [400.0]
    assert _closes(adjust_splits(bars, zero.limit(0))) == [400.0]


def test_of_two_actions_on_one_day_one_applies(spark, make_bars):
    bars = _daily(make_bars, ("2020-08-26", 400), ("2020-08-27", 400))
    splits = spark.createDataFrame(
        [("stocks:AAA", day("2020-08-27"), 0.5), ("stocks:AAA", day("2020-08-27"), 0.25),
         ("stocks:AAA", day("2020-08-28"), 0.8)],
        SPLITS,
    )
    assert _closes(adjust_splits(bars, splits)) == [100.0, 320.0]


def test_unadjust_is_the_inverse(spark, make_bars):
    splits = spark.createDataFrame([("stocks:AAA", day("2020-08-31"), 0.25)], SPLITS)
    bars = _daily(make_bars, ("2020-08-28", 125.5), ("2020-08-31", 130.5))
    raw = unadjust_splits(bars, splits)
    assert _closes(raw) == [502.0, 130.5]
    assert _closes(adjust_splits(raw, splits)) == [125.5, 130.5]


def test_cumulative_split_factors(spark):
    splits = spark.createDataFrame(
        [("k", day("2020-01-01"), 2.0), ("k", day("2022-01-01"), 4.0), ("k", day("2023-01-01"), 0.0),
         ("other", day("2021-01-01"), None)],
        RATIOS,
    )
    out = {(r.instrument_key, r.execution_date.year): r.historical_adjustment_factor
           for r in split_factors(splits).collect()}
    assert out == {("k", 2020): 0.125, ("k", 2022): 0.25, ("k", 2023): 1.0, ("other", 2021): 1.0}


def test_dividend_factor_from_the_close_before(spark, make_bars):
    bars = _daily(make_bars, ("2024-05-30", 90), ("2024-05-31", 100), ("2024-06-01", 50))
    dividends = spark.createDataFrame(
        [("stocks:AAA", day("2024-06-01"), 1.0), ("stocks:AAA", day("2024-05-01"), 5.0),
         ("stocks:AAA", day("2024-06-10"), 500.0)],
        DIVIDENDS,
    )
    out = dividend_factors(dividends, bars).orderBy("ex_dividend_date").collect()
    # no close before May, and an amount above the close: both leave the factor alone
    assert [r.historical_adjustment_factor for r in out] == pytest.approx([0.99, 0.99, 1.0])
    adjusted = adjust_dividends(bars, dividend_factors(dividends, bars))
    assert _closes(adjusted) == [89.1, 99.0, 50.0]


def test_several_ex_dates_between_two_closes(spark, make_bars):
    bars = _daily(make_bars, ("2024-05-01", 100))
    dividends = spark.createDataFrame(
        [("stocks:AAA", day("2024-05-02"), 10.0), ("stocks:AAA", day("2024-05-03"), 10.0)],
        DIVIDENDS,
    )
    out = dividend_factors(dividends, bars).orderBy("ex_dividend_date").collect()
    assert [r.historical_adjustment_factor for r in out] == pytest.approx([0.81, 0.9])
