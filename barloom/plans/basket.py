"""Bars of weighted baskets from stored bars: adjusted legs, combined, resampled.

The bars are scanned once. The list of series that have bars comes from the
manifest, splits and dividends reach a bar by one as-of join, and one shuffle
adds up the legs. The sums, a row per basket and time, are stored; base and
session bounds are taken from them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.adjust import adjust_actions
from barloom.operators.basket import basket_legs, combined_legs, rebased, with_legs
from barloom.operators.filters import filter_range
from barloom.plans.bar_query import BarQuery, query_bars
from barloom.schema import KEY, on_track
from barloom.session import materialize


def query_baskets(
    bars: DataFrame,
    weights: DataFrame,
    query: BarQuery,
    *,
    traded: DataFrame,
    splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
    rebase: float = 100.0,
) -> DataFrame:
    """Bars of every basket at the query's time scale, from the adjusted bars of its legs.

    ``traded`` lists the series that have bars in the query's range, as
    ``manifest.held_rows`` tells; bars of other series don't count. Splits are
    applied unless ``split_adjust`` is off, dividends if ``adjust`` is on, both
    to stocks only. Hours, time scale, limit and columns apply to the combined
    bars. A basket is not on a tick grid and has no rolls: adjust the bars of
    futures beforehand.
    """
    if query.normalize_ticks:
        raise ValueError("the price of a basket is not on a tick grid")
    resolution = query.check(has_chain=False)["resolution"]
    stock = F.startswith(KEY, F.lit("stocks:"))
    held = filter_range(on_track(bars, resolution), query.start, query.end)
    adjusted = adjust_actions(
        with_legs(held, basket_legs(weights, on_track(traded, resolution)), weights),
        splits.filter(stock) if query.split_adjust and splits is not None else None,
        dividends.filter(stock) if query.adjust and dividends is not None else None,
    )
    sums = materialize(combined_legs(adjusted), "basket-sums")
    whole = replace(query, start=None, end=None, adjust=False, dedupe=False)
    return query_bars(rebased(sums, weights, rebase=rebase), whole)
