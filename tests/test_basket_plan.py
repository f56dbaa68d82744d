import pytest
from helpers import day

from barloom.operators.adjust import adjust_actions, adjust_dividends, adjust_splits
from barloom.operators.basket import leg_report
from barloom.plans.bar_query import BarQuery
from barloom.plans.basket import query_baskets

FACTORS = "instrument_key string, {} date, historical_adjustment_factor double"


@pytest.fixture(scope="module")
def bars(make_bars):
    days = [(f"2024-01-{d:02d}T00:00", 100.0 + d) for d in range(1, 13)]
    one = make_bars(days, symbol="AAA", resolution="1day")
    return one.unionByName(make_bars(days[2:], symbol="BBB", resolution="1day")).drop("resolution")


@pytest.fixture(scope="module")
def actions(spark):
    splits = [("stocks:AAA", day("2024-01-04"), 0.25), ("stocks:AAA", day("2024-01-08"), 0.5),
              ("stocks:AAA", day("2024-01-08"), 0.75), ("stocks:BBB", day("2024-01-05"), 0.0),
              ("stocks:BBB", None, 0.1)]
    dividends = [("stocks:AAA", day("2024-01-04"), 0.9), ("stocks:AAA", day("2024-01-10"), 0.95),
                 ("stocks:BBB", day("2024-01-20"), 0.8)]
    return (spark.createDataFrame(splits, FACTORS.format("execution_date")),
            spark.createDataFrame(dividends, FACTORS.format("ex_dividend_date")))


def _closes(df):
    rows = df.select("instrument_key", "window_start", "close").collect()
    return {(r[0], r[1]): pytest.approx(r[2]) for r in rows}


def test_one_join_equals_two(bars, actions):
    splits, dividends = actions
    two = adjust_dividends(adjust_splits(bars, splits), dividends)
    assert _closes(adjust_actions(bars, splits, dividends)) == _closes(two)
    assert _closes(adjust_actions(bars, splits, None)) == _closes(adjust_splits(bars, splits))
    assert _closes(adjust_actions(bars, None, dividends)) == _closes(adjust_dividends(bars, dividends))
    assert adjust_actions(bars, None, None) is bars


def test_basket_of_adjusted_legs(spark, bars, actions):
    weights = spark.createDataFrame(
        [("b", "stocks:AAA", 3.0), ("b", "stocks:BBB", 1.0), ("b", "stocks:ZZZ", 5.0)],
        "basket string, instrument_key string, weight double",
    )
    traded = bars.select("instrument_key").distinct()
    found = query_baskets(
        bars, weights, BarQuery("1day", start="2024-01-04", adjust=True), traded=traded,
        splits=actions[0], dividends=actions[1],
    )
    closes = [r[0] for r in found.orderBy("window_start").select("close").collect()]

    def leg(d):
        split = 0.5 if d < 8 else 1.0
        dividend = 0.95 if d < 10 else 1.0
        return 0.75 * (100.5 + d) * split * dividend + 0.25 * (100.5 + d) * 0.8

    assert closes == pytest.approx([100 * leg(d) / leg(4) for d in range(4, 13)])


def test_legs_left_out_have_a_reason(spark, bars):
    weights = spark.createDataFrame(
        [("b", "stocks:AAA", 3.0), ("b", "stocks:BBB", 0.0), ("b", "stocks:ZZZ", 5.0),
         ("b", "stocks:YYY", None)],
        "basket string, instrument_key string, weight double",
    )
    rows = leg_report(weights, bars).select("instrument_key", "part", "left_out").collect()
    assert {tuple(r) for r in rows} == {
        ("stocks:AAA", 1.0, None), ("stocks:BBB", None, "weight"),
        ("stocks:ZZZ", None, "no bars"), ("stocks:YYY", None, "weight"),
    }


def test_tick_grid_is_refused(spark, bars):
    with pytest.raises(ValueError, match="tick grid"):
        query_baskets(bars, bars, BarQuery(normalize_ticks=True), traded=bars)
