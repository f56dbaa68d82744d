import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import allocate, panel, portfolio, risk
from barloom.operators.basket import basket_bars
from barloom.operators.rates import resolve_rates, yield_quotes

WEIGHTS = "universe string, portfolio_id string, symbol string, weight double"


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(42)
    rows = []
    for symbol, drift in (("AAA", 0.0006), ("BBB", 0.0003), ("CCC", 0.0001)):
        walk = 100 * np.exp(np.cumsum(rng.normal(drift, 0.01, 300)))
        rows += [("u", symbol, i, float(p)) for i, p in enumerate(walk)]
    rows += [("u", "THIN", i, 50.0) for i in range(8)]
    return spark.createDataFrame(rows, "universe string, symbol string, i int, close double").select(
        "universe", "symbol", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("date"),
        "close",
    )


@pytest.fixture(scope="module")
def members(spark):
    rows = [("u", f"stocks:{s}", s) for s in ("AAA", "BBB", "CCC", "THIN")]
    return spark.createDataFrame(rows, "universe string, instrument_key string, symbol string")


@pytest.fixture(scope="module")
def rets(prices, members):
    return panel.returns(panel.price_panel(prices, members)).cache()


@pytest.fixture(scope="module")
def matrix(rets):
    rows = rets.groupBy("date").pivot("symbol").agg(F.first("ret")).orderBy("date").toPandas()
    return rows[["AAA", "BBB", "CCC"]].to_numpy()


def test_thin_symbol_is_dropped_and_dates_kept(prices, members):
    kept = panel.price_panel(prices, members)
    assert {r.symbol for r in kept.select("symbol").distinct().collect()} == {"AAA", "BBB", "CCC"}
    assert kept.count() == 900
    row = panel.panel_status(prices, members).first()
    assert (row.n_kept, row.n_dropped, row.n_dates, row.status) == (3, 1, 300, "ok")


def test_universe_failing_the_rules_is_named(prices, members):
    lonely = prices.filter("symbol = 'AAA'")
    assert panel.price_panel(lonely, members).count() == 0
    assert panel.panel_status(lonely, members).first().status == "too_few_symbols"
    brief = prices.filter("date < '2020-01-04'")
    assert panel.panel_status(brief, members).first().status == "too_few_dates"


def test_stats_match_numpy(rets, matrix):
    rows = {r.symbol: r for r in risk.asset_stats(rets, 252.0, 0.04).collect()}
    for j, symbol in enumerate(("AAA", "BBB", "CCC")):
        mean = matrix[:, j].mean() * 252
        vol = matrix[:, j].std(ddof=1) * np.sqrt(252)
        row = rows[symbol]
        assert row.mean_ann == pytest.approx(mean)
        assert row.vol_ann == pytest.approx(vol)
        assert row.sharpe == pytest.approx((mean - 0.04) / vol)
        assert row.n_obs == 299


def _model(rets):
    stats = risk.asset_stats(rets, 252.0, 0.04)
    cov = risk.regularized(risk.covariance_matrix(risk.pair_moments(rets), 252.0))
    return stats, cov


def test_performance_matches_numpy(spark, rets, matrix):
    stats, cov = _model(rets)
    weights = spark.createDataFrame(
        [("u", "p", "AAA", 2.0), ("u", "p", "BBB", 1.0), ("u", "p", "CCC", -5.0),
         ("u", "zero", "AAA", 0.0), ("u", "zero", "BBB", 0.0), ("u", "zero", "CCC", 0.0)],
        WEIGHTS,
    )
    out = {r.portfolio_id: r for r in portfolio.performance(weights, stats, cov).collect()}
    sigma = np.cov(matrix, rowvar=False) * 252 + np.eye(3) * 1e-10
    for name, w in (("p", np.array([2 / 3, 1 / 3, 0])), ("zero", np.full(3, 1 / 3))):
        assert out[name].mean_ann == pytest.approx(w @ matrix.mean(axis=0) * 252)
        assert out[name].vol_ann == pytest.approx(np.sqrt(w @ sigma @ w))


@pytest.mark.parametrize("size", [1, 2, 128])
def test_performance_does_not_depend_on_the_blocks(spark, rets, matrix, size):
    stats, cov = _model(rets)
    weights = portfolio.sampled_weights(stats.select("universe", "symbol"), 20)
    out = portfolio.performance(weights, stats, cov, symbols_per_block=size).collect()
    sigma = np.cov(matrix, rowvar=False) * 252 + np.eye(3) * 1e-10
    held = {(r.portfolio_id, r.symbol): r.weight for r in weights.collect()}
    assert len(out) == 20
    for row in out:
        w = np.array([held[row.portfolio_id, s] for s in ("AAA", "BBB", "CCC")])
        assert row.vol_ann == pytest.approx(np.sqrt(w @ sigma @ w))


def test_zero_and_negative_closes_drop_whole_dates(spark):
    closes = {"A": [1.0, 2.0, 0.0, 4.0, 5.0, 7.0, 9.0], "B": [3.0, 4.0, 5.0, 6.0, -7.0, 8.0, 7.0]}
    rows = [("u", s, d, c) for s, cs in closes.items() for d, c in enumerate(cs)]
    prices = spark.createDataFrame(rows, "universe string, symbol string, date int, close double")
    dates = {
        kind: {
            s: sorted(r.date for r in panel.returns(prices, kind).filter(F.col("symbol") == s).collect())
            for s in closes
        }
        for kind in ("simple", "log")
    }
    assert dates["simple"] == {s: [1, 2, 4, 5, 6] for s in closes}
    assert dates["log"] == {s: [1, 6] for s in closes}


def test_selection_and_frontier(rets):
    stats, cov = _model(rets)
    symbols = stats.select("universe", "symbol")
    weights = portfolio.candidates(symbols, n_samples=400)
    sums = weights.groupBy("portfolio_id").agg(F.sum("weight").alias("s"), F.min("weight").alias("m"))
    assert sums.filter("abs(s - 1) > 1e-9 OR m < 0").count() == 0
    evaluated = portfolio.performance(weights, stats, cov, portfolios=401).cache()
    assert evaluated.count() == 401
    best = {o: portfolio.select_best(evaluated, o).first() for o in ("equal", "minvol", "sharpe")}
    assert best["minvol"].vol_ann <= best["equal"].vol_ann
    assert best["sharpe"].sharpe >= best["equal"].sharpe
    points = portfolio.frontier(evaluated, 15).orderBy("vol_ann").collect()
    means = [p.mean_ann for p in points]
    assert means == sorted(means) and len(points) > 1
    with pytest.raises(ValueError):
        portfolio.select_best(evaluated, "luck")


def test_samples_do_not_depend_on_partitioning(spark):
    symbols = spark.createDataFrame([("u", s) for s in "ABCDE"], "universe string, symbol string")
    one = portfolio.sampled_weights(symbols.coalesce(1), 50).collect()
    many = portfolio.sampled_weights(symbols.repartition(5), 50).collect()
    assert sorted(one) == sorted(many)
    assert sorted(one) != sorted(portfolio.sampled_weights(symbols, 50, seed=7).collect())


def test_flat_returns_leave_one_frontier_point(spark):
    rows = [("u", f"p{i}", 0.1, 0.2 + i / 10, 0.5) for i in range(4)]
    evaluated = spark.createDataFrame(
        rows, "universe string, portfolio_id string, mean_ann double, vol_ann double, sharpe double"
    )
    assert [r.portfolio_id for r in portfolio.frontier(evaluated).collect()] == ["p0"]


def _allocate(spark, weights, prices, value):
    w = spark.createDataFrame([("u", "p", s, float(x)) for s, x in weights.items()], WEIGHTS)
    p = spark.createDataFrame([("u", s, float(x)) for s, x in prices.items()],
                              "universe string, symbol string, price double")
    return w, p, allocate.allocate_discrete(w, p, value)


def test_allocation_examples(spark):
    _, _, out = _allocate(spark, {"A": 0.5, "B": 0.5}, {"A": 100, "B": 50}, 1000)
    assert {r.symbol: r.shares for r in out.collect()} == {"A": 5, "B": 10}
    row = allocate.allocation_summary(out).first()
    assert (row.invested, row.cash, row.drift_l1) == (1000.0, 0.0, pytest.approx(0.0))
    w, p, out = _allocate(spark, {"A": 0.5, "B": 0.5, "C": 0.1}, {"A": 50_000, "B": 50}, 1000)
    assert {r.symbol: r.shares for r in out.collect()} == {"B": 20}
    assert {r.symbol: r.reason for r in allocate.skipped_symbols(w, p, 1000).collect()} == {
        "A": "price_above_capital", "C": "no_price"
    }
    with pytest.raises(ValueError):
        allocate.allocate_discrete(w, p, 0)


def _search(weights, prices, value):
    """Residual allocation by repeated search, as a plain restatement of the rule."""
    names = sorted(weights)
    total = sum(weights.values())
    target = {s: weights[s] / total * value for s in names}
    shares, cap = {}, {}
    for s in names:
        reachable = target[s] + 1e-9 >= prices[s]
        shares[s] = int(np.floor(target[s] / prices[s] + 1e-12)) if reachable else 0
        cap[s] = int(np.ceil(target[s] / prices[s] - 1e-12)) if reachable else 0
    cash = value - sum(shares[s] * prices[s] for s in names)
    while True:
        short = [s for s in names if shares[s] < cap[s] and prices[s] <= cash + 1e-12
                 and target[s] - shares[s] * prices[s] > 1e-9]
        if not short:
            return shares
        pick = max(short, key=lambda s: target[s] - shares[s] * prices[s])
        shares[pick] += 1
        cash -= prices[pick]


def test_allocation_equals_repeated_search(spark):
    rng = random.Random(1)
    rows, prices, expected = [], [], {}
    for case in range(200):
        names = [f"S{i:02d}" for i in range(rng.randint(1, 9))]
        weights = {s: rng.random() + 0.001 for s in names}
        total = sum(weights.values())
        weights = {s: w / total for s, w in weights.items()}
        price = {s: round(rng.uniform(1, 400), 2) for s in names}
        expected[f"u{case}"] = _search(weights, price, 1000.0)
        rows += [(f"u{case}", "p", s, w) for s, w in weights.items()]
        prices += [(f"u{case}", s, p) for s, p in price.items()]
    out = allocate.allocate_discrete(
        spark.createDataFrame(rows, WEIGHTS),
        spark.createDataFrame(prices, "universe string, symbol string, price double"),
        1000.0,
    )
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.universe, {})[r.symbol] = r.shares
    assert got == expected


def test_basket(spark, make_bars):
    bars = make_bars([("2024-01-01 00:00", 99.5), ("2024-01-02 00:00", 109.5)], symbol="A",
                     resolution="1day")
    bars = bars.unionByName(
        make_bars([("2024-01-01 00:00", 49.5), ("2024-01-02 00:00", 49.5),
                   ("2024-01-03 00:00", 49.5)], symbol="B", resolution="1day")
    )
    weights = spark.createDataFrame(
        [("b", "stocks:A", 3.0), ("b", "stocks:B", 2.0), ("b", "stocks:GONE", 5.0),
         ("lost", "stocks:GONE", 1.0)],
        "basket string, instrument_key string, weight double",
    )
    rows = basket_bars(bars, weights).orderBy("window_start").collect()
    assert [round(r.close, 9) for r in rows] == [100.0, 107.5]
    assert {r.ticker for r in rows} == {"PORTFOLIO"}
    assert rows[0].volume == pytest.approx(100.0)
    assert rows[1].dollar_volume == pytest.approx(rows[1].close * rows[1].volume)


def test_rates(spark, make_bars):
    bars = make_bars([("2024-01-01 00:00", 3.5), ("2024-01-02 00:00", 3.7)], kind="indices",
                     symbol="IRX", resolution="1day")
    requests = spark.createDataFrame(
        [("a", "indices:IRX", 0.01), ("b", "indices:IRX", None), ("c", None, None)],
        "request string, series_key string, explicit_rate double",
    )
    out = {r.request: (r.source, round(r.risk_free_rate, 6), str(r.as_of))
           for r in resolve_rates(requests, yield_quotes(bars), 0.04).collect()}
    assert out == {"a": ("explicit", 0.01, "None"), "b": ("series", 0.042, "2024-01-02"),
                   "c": ("static", 0.04, "None")}


def test_allocation_of_many_symbols_equals_the_greedy_search(spark):
    n, value = 200, 50_000.0
    prices = [("u", f"S{i:03d}", 3.0 + (i * 37 % 101)) for i in range(n)]
    raw = [1.0 + (i * 53 % 29) for i in range(n)]
    weights = [("u", "p", f"S{i:03d}", raw[i] / sum(raw)) for i in range(n)]
    got = allocate.allocate_discrete(
        spark.createDataFrame(weights, "universe string, portfolio_id string, symbol string, weight double"),
        spark.createDataFrame(prices, "universe string, symbol string, price double"),
        value,
    )
    price = {s: p for _, s, p in prices}
    target = {s: w * value for _, _, s, w in weights}
    shares = {s: int(t / price[s] + 1e-12) if t + 1e-9 >= price[s] else 0 for s, t in target.items()}
    cap = {s: math.ceil(t / price[s] - 1e-12) if t + 1e-9 >= price[s] else 0 for s, t in target.items()}
    cash = value - sum(shares[s] * price[s] for s in shares)
    while True:
        short = [(t - shares[s] * price[s], s) for s, t in target.items()
                 if shares[s] < cap[s] and price[s] <= cash + 1e-12 and t - shares[s] * price[s] > 1e-9]
        if not short:
            break
        best = min(short, key=lambda x: (-x[0], x[1]))[1]
        shares[best] += 1
        cash -= price[best]
    assert {r.symbol: r.shares for r in got.collect()} == shares
