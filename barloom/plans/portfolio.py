"""From bars and universes to chosen portfolios, in one chain of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.operators.panel import panel_closes, periods_per_year, price_panel, returns
from barloom.operators.portfolio import candidates, performance
from barloom.operators.risk import asset_stats, covariance_matrix, pair_moments, regularized
from barloom.schema import MIN_COVERAGE, SAMPLES, SEED
from barloom.session import materialize


@dataclass(frozen=True)
class Research:
    """Tables of one portfolio study, all lazy and in long form."""

    panel: DataFrame
    returns: DataFrame
    stats: DataFrame
    moments: DataFrame
    covariance: DataFrame
    weights: DataFrame
    evaluated: DataFrame


def study(
    bars: DataFrame,
    universes: DataFrame,
    *,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
    timescale: str = "day",
    kind: str = "simple",
    min_coverage: float = MIN_COVERAGE,
    risk_free_rate: float = 0.04,
    n_samples: int = SAMPLES,
    seed: int = SEED,
    **bounds,
) -> Research:
    """Panel, returns, statistics, covariance, candidate weights and their performance.

    Closes, returns and pair moments feed several steps each; they are written
    once, so the bars are read a single time.
    """
    closes = panel_closes(
        bars, universes, splits=splits, dividends=dividends, timescale=timescale, **bounds
    )
    panel = price_panel(materialize(closes, "closes"), universes, min_coverage)
    rets = materialize(returns(panel, kind), "returns")
    periods = periods_per_year(timescale)
    stats = asset_stats(rets, periods, risk_free_rate)
    moments = materialize(pair_moments(rets), "moments")
    cov = regularized(covariance_matrix(moments, periods))
    symbols = stats.select("universe", "symbol")
    weights = candidates(symbols, n_samples=n_samples, seed=seed)
    evaluated = performance(weights, stats, cov, risk_free_rate, portfolios=n_samples + 1)
    return Research(panel, rets, stats, moments, cov, weights, evaluated)
