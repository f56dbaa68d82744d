"""Turning weights into whole shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.lookup import lookup_join
from barloom.operators.portfolio import PORTFOLIO
from barloom.schema import MIN_WEIGHT


#: Decisions packed into one number, so that a fold doesn't copy all of them at each step.
PACKED = 62


def _buy_residual(acc: Column, row: Column) -> Column:
    """Buy one more share of a row that is still short, if the cash allows it."""
    buys = (row.floor < row.cap) & (row.deficit > 1e-9) & (row.price <= acc.cash + 1e-12)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), acc.n)
    pack = acc.pack + F.when(buys, bit).otherwise(F.lit(0).cast("bigint"))
    full = acc.n == PACKED - 1
    return F.struct(
        (acc.cash - F.when(buys, row.price).otherwise(0.0)).alias("cash"),
        F.when(full, F.lit(0).cast("bigint")).otherwise(pack).alias("pack"),
        F.when(full, F.lit(0)).otherwise(acc.n + 1).alias("n"),
        F.when(full, F.array_append(acc.packs, pack)).otherwise(acc.packs).alias("packs"),
    )


def _bought(packs: Column, i: Column) -> Column:
    """Whether the i-th row of the fold was bought, as 0 or 1."""
    pack = F.get(packs, F.floor(i / PACKED).cast("int"))
    return F.call_function("shiftright", pack, (i % PACKED).cast("int")).bitwiseAND(F.lit(1))


def allocate_discrete(
    weights: DataFrame, prices: DataFrame, value: float, *, min_weight: float = MIN_WEIGHT
) -> DataFrame:
    """Whole shares per portfolio from its weights, latest prices and a capital.

    Shares are floored; the cash left goes to the largest dollar deficits it
    can pay for. A symbol can gain at most one share and the cash only
    shrinks, so one fold over the symbols by deficit gives the same result as
    repeated search. One row per allocatable symbol, shares may be 0.
    """
    if value <= 0:
        raise ValueError("value must be positive")
    whole = W.partitionBy(*PORTFOLIO)
    known = lookup_join(weights, prices, ["universe", "symbol"], bounded_by=prices)
    usable = known.filter(
        (F.col("weight") >= min_weight) & (F.col("price") > 0) & (F.col("price") <= value)
    )
    target = F.col("weight_th") * value
    ratio = F.col("target") / F.col("price")
    reachable = F.col("target") + 1e-9 >= F.col("price")
    lots = (
        usable.withColumn("weight_th", F.col("weight") / F.sum("weight").over(whole))
        .withColumn("target", target)
        .withColumn("floor", F.when(reachable, F.floor(ratio + 1e-12)).otherwise(F.lit(0)))
        .withColumn("cap", F.when(reachable, F.ceil(ratio - 1e-12)).otherwise(F.lit(0)))
        .withColumn("deficit", F.col("target") - F.col("floor") * F.col("price"))
    )
    row = F.struct(
        (-F.col("deficit")).alias("order"), "symbol", "floor", "cap", "deficit", "price",
        "weight_th",
    )
    start = F.struct(
        (F.lit(float(value)) - F.col("_spent")).alias("cash"),
        F.lit(0).cast("bigint").alias("pack"),
        F.lit(0).alias("n"),
        F.array().cast("array<bigint>").alias("packs"),
    )
    folded = (
        lots.groupBy(*PORTFOLIO)
        .agg(
            F.array_sort(F.collect_list(row)).alias("_rows"),
            F.sum(F.col("floor") * F.col("price")).alias("_spent"),
        )
        .withColumn("_fold", F.aggregate("_rows", start, _buy_residual))
        .withColumn("_packs", F.array_append("_fold.packs", F.col("_fold.pack")))
    )
    # what the fold bought stands at the position of its row
    both = F.transform(
        "_rows",
        lambda row, i: F.struct(row.alias("row"), _bought(F.col("_packs"), i).alias("extra")),
    )
    bought = folded.select(*PORTFOLIO, F.inline(both)).select(
        *PORTFOLIO,
        "row.symbol",
        "row.price",
        "row.weight_th",
        (F.col("row.floor") + F.col("extra")).alias("shares"),
    )
    notional = F.col("shares") * F.col("price")
    invested = F.sum("notional").over(whole)
    effective = F.when(F.col("invested") > 1e-12, F.col("notional") / F.col("invested"))
    return (
        bought.withColumn("notional", notional)
        .withColumn("invested", invested)
        .withColumn("weight_eff", F.coalesce(effective, F.lit(0.0)))
        .withColumn("cash", F.lit(float(value)) - F.col("invested"))
    )


def skipped_symbols(
    weights: DataFrame, prices: DataFrame, value: float, *, min_weight: float = MIN_WEIGHT
) -> DataFrame:
    """Weighted symbols that cannot be bought, with the reason."""
    known = lookup_join(weights, prices, ["universe", "symbol"], bounded_by=prices)
    reason = F.when(F.coalesce("price", F.lit(0.0)) <= 0, "no_price").when(
        F.col("price") > value, "price_above_capital"
    )
    return (
        known.filter(F.col("weight") >= min_weight)
        .withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .select(*PORTFOLIO, "symbol", "reason")
    )


def lots_table(allocation: DataFrame) -> DataFrame:
    """Lots with at least one share, largest first."""
    return (
        allocation.filter("shares > 0")
        .select(*PORTFOLIO, "symbol", "shares", "price", "notional", "weight_th", "weight_eff")
        .orderBy(*PORTFOLIO, F.desc("notional"), "symbol")
    )


def allocation_summary(allocation: DataFrame) -> DataFrame:
    """Invested capital, cash and distance between wanted and reached weights."""
    return allocation.groupBy(*PORTFOLIO).agg(
        F.max("invested").alias("invested"),
        F.max("cash").alias("cash"),
        F.sum(F.abs(F.col("weight_th") - F.col("weight_eff"))).alias("drift_l1"),
        F.count_if(F.col("shares") > 0).alias("lots"),
    )
