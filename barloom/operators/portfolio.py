"""Weights, performance, selection and the sampled frontier.

Portfolios are long tables ``(universe, portfolio_id, symbol, weight)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.lookup import lookup_join
from barloom.operators.risk import SYMBOLS_PER_BLOCK
from barloom.schema import FRONTIER_POINTS, SAMPLES, SEED

PORTFOLIO = ["universe", "portfolio_id"]
PARTS = "universe string, portfolio_id string, part double"
PORTFOLIOS_PER_TASK = 2048
# 13 hexadecimal digits of a digest are an exact double.
UNIFORM_STEPS = float(16**13)


def long_only(weights: DataFrame) -> DataFrame:
    """Clip at zero and rescale to one; a portfolio without weight becomes equal."""
    whole = W.partitionBy(*PORTFOLIO)
    clipped = weights.withColumn("weight", F.greatest("weight", F.lit(0.0)))
    total = F.sum("weight").over(whole)
    scaled = F.when(total > 1e-15, F.col("weight") / total).otherwise(
        F.lit(1.0) / F.count("*").over(whole)
    )
    return clipped.withColumn("weight", scaled)


def equal_weights(symbols: DataFrame) -> DataFrame:
    """``1/n`` per universe, as portfolio ``equal``."""
    share = F.lit(1.0) / F.count("*").over(W.partitionBy("universe"))
    return symbols.select(
        "universe", F.lit("equal").alias("portfolio_id"), "symbol", share.alias("weight")
    )


def sampled_weights(symbols: DataFrame, n_samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Portfolios drawn uniformly from the simplex, the same under any partitioning.

    Exponential draws rescaled to one are uniform on the simplex; each draw comes
    from a digest of (seed, sample, symbol) instead of a generator's state.
    """
    drawn = symbols.repartition("universe", "symbol").select(
        "universe",
        "symbol",
        F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"),
    )
    digest = F.md5(F.concat_ws("|", F.lit(seed), "sample", "symbol").cast("binary"))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    draw = -F.ln((number + F.lit(0.5)) / F.lit(UNIFORM_STEPS))
    whole = W.partitionBy("universe", "sample")
    return drawn.withColumn("_draw", draw).select(
        "universe",
        F.concat(F.lit("sample-"), "sample").alias("portfolio_id"),
        "symbol",
        (F.col("_draw") / F.sum("_draw").over(whole)).alias("weight"),
    )


# The task function below is a closure, so that executors need not have this package.


def _block_variance():
    def partial(weights: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        """Share of a pair of symbol blocks in the variance of a chunk of portfolios."""
        if weights.empty or entries.empty:
            return pd.DataFrame(columns=["universe", "portfolio_id", "part"])
        table = weights.pivot_table(
            index="portfolio_id", columns="symbol", values="weight", aggfunc="sum"
        ).fillna(0.0)
        place = pd.Series(range(table.shape[1]), index=table.columns)
        known = entries[entries["symbol_a"].isin(place.index) & entries["symbol_b"].isin(place.index)]
        one, other = place[known["symbol_a"]].to_numpy(), place[known["symbol_b"]].to_numpy()
        cov = np.zeros((len(place), len(place)))
        # one triangle is stored: a pair off the diagonal counts twice
        cov[one, other] = known["cov"].to_numpy() * np.where(one == other, 1.0, 2.0)
        matrix = table.to_numpy()
        return pd.DataFrame(
            {
                "universe": weights["universe"].iloc[0],
                "portfolio_id": table.index,
                "part": np.einsum("ij,ij->i", matrix @ cov, matrix),
            }
        )

    return partial


def performance(
    weights: DataFrame,
    stats: DataFrame,
    cov: DataFrame,
    risk_free_rate: float = 0.04,
    *,
    portfolios: int = SAMPLES,
    symbols_per_block: int = SYMBOLS_PER_BLOCK,
) -> DataFrame:
    """Annual mean, volatility and Sharpe of every portfolio.

    ``cov`` holds pairs ``symbol_a <= symbol_b``. The variance is a sum over
    pairs of symbol blocks: a task holds a chunk of portfolios on two blocks and
    the covariances between them, never a whole matrix. ``portfolios`` is the
    expected number per universe and sets the number of chunks.
    """
    chunks = max(1, -(-int(portfolios) // PORTFOLIOS_PER_TASK))
    blocks = stats.groupBy("universe").agg(
        F.ceil(F.count("*") / symbols_per_block).cast("int").alias("_blocks")
    )

    def block(symbol: str) -> Column:
        return F.pmod(F.xxhash64(symbol), F.col("_blocks")).cast("int")

    held = (
        long_only(weights)
        .join(stats.select("universe", "symbol", "mean_ann"), ["universe", "symbol"])
        .withColumn("_chunk", F.pmod(F.xxhash64("portfolio_id"), F.lit(chunks)).cast("int"))
    )
    means = held.groupBy(*PORTFOLIO).agg(
        F.sum(F.col("weight") * F.col("mean_ann")).alias("mean_ann")
    )
    pairs = ["universe", "_chunk", "_low", "_high"]
    split = (
        held.drop("mean_ann")
        .join(blocks, "universe")
        .withColumn("_block", block("symbol"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "universe", "_chunk", "portfolio_id", "symbol", "weight",
            F.least("_block", "_other").alias("_low"),
            F.greatest("_block", "_other").alias("_high"),
        )
    )
    entries = (
        cov.join(blocks, "universe")
        .withColumns({"_a": block("symbol_a"), "_b": block("symbol_b")})
        .select(
            "universe", "symbol_a", "symbol_b", "cov",
            F.least("_a", "_b").alias("_low"), F.greatest("_a", "_b").alias("_high"),
            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"),
        )
    )
    variance = (
        split.groupBy(*pairs)
        .cogroup(entries.groupBy(*pairs))
        .applyInPandas(_block_variance(), PARTS)
        .groupBy(*PORTFOLIO)
        .agg(F.sqrt(F.greatest(F.sum("part"), F.lit(0.0))).alias("vol_ann"))
    )
    return with_sharpe(means.join(variance, PORTFOLIO), risk_free_rate)


def with_sharpe(moments: DataFrame, risk_free_rate: float) -> DataFrame:
    excess = (F.col("mean_ann") - risk_free_rate) / F.col("vol_ann")
    return moments.withColumn("sharpe", F.when(F.col("vol_ann") > 1e-15, excess))


def candidates(
    symbols: DataFrame, *, n_samples: int = SAMPLES, seed: int = SEED
) -> DataFrame:
    """The equal portfolio together with the samples."""
    return equal_weights(symbols).unionByName(sampled_weights(symbols, n_samples, seed))


# Accepted names of the three objectives.
OBJECTIVES = {
    "equal": "equal", "ew": "equal", "1/n": "equal",
    "min-vol": "min-vol", "minvol": "min-vol", "min-variance": "min-vol", "min-var": "min-vol",
    "max-sharpe": "max-sharpe", "sharpe": "max-sharpe", "tangency": "max-sharpe",
}


def select_best(evaluated: DataFrame, objective: str) -> DataFrame:
    """Best portfolio per universe: equal, least volatility or highest Sharpe."""
    name = OBJECTIVES.get(objective.strip().lower().replace("_", "-"))
    if name is None:
        raise ValueError(f"unknown objective {objective!r}: equal, min-vol or max-sharpe")
    row = F.struct("portfolio_id", "mean_ann", "vol_ann", "sharpe")
    if name == "equal":
        best = evaluated.filter("portfolio_id = 'equal'").select("universe", row.alias("_r"))
    elif name == "min-vol":
        best = evaluated.groupBy("universe").agg(
            F.min_by(row, F.struct("vol_ann", "portfolio_id")).alias("_r")
        )
    else:
        best = (
            evaluated.filter("sharpe IS NOT NULL")
            .groupBy("universe")
            .agg(F.min_by(row, F.struct(-F.col("sharpe"), "portfolio_id")).alias("_r"))
        )
    return best.select("universe", F.lit(name).alias("objective"), "_r.*")


def frontier(evaluated: DataFrame, n_points: int = FRONTIER_POINTS) -> DataFrame:
    """Sampled efficient frontier per universe.

    Returns are cut into equal-width buckets whose edges belong to both
    neighbours, the least volatile portfolio of each bucket is kept, and of
    those, in order of volatility, the ones that do not fall behind the best
    mean so far. With no spread of returns one point is left.
    """
    spread = evaluated.groupBy("universe").agg(
        F.min("mean_ann").alias("_lo"), F.max("mean_ann").alias("_hi")
    )
    step = (F.col("_hi") - F.col("_lo")) / n_points
    flat = (F.col("_hi") - F.col("_lo")) < 1e-12
    near = F.floor((F.col("mean_ann") - F.col("_lo")) / F.nullif(F.col("_step"), F.lit(0.0)))
    around = F.array(*[F.coalesce(near, F.lit(0)) + d for d in (-1, 0, 1)])
    lower = F.col("_lo") + F.col("_bucket") * F.col("_step")
    upper = F.when(F.col("_bucket") == n_points - 1, F.col("_hi")).otherwise(
        F.col("_lo") + (F.col("_bucket") + 1) * F.col("_step")
    )
    inside = (
        F.col("_bucket").between(0, n_points - 1)
        & (F.col("mean_ann") >= lower)
        & (F.col("mean_ann") <= upper)
    )
    row = F.struct("portfolio_id", "mean_ann", "vol_ann", "sharpe")
    best = (
        lookup_join(evaluated, spread, ["universe"], how="inner")
        .withColumns({"_step": step, "_flat": flat})
        .withColumn("_bucket", F.explode(F.when(F.col("_flat"), F.array(F.lit(0).cast("bigint")))
                                         .otherwise(around)))
        .filter(F.col("_flat") | inside)
        .groupBy("universe", "_bucket")
        .agg(F.min_by(row, F.struct("vol_ann", "portfolio_id")).alias("_r"))
        .select("universe", "_r.*")
    )
    earlier = (
        W.partitionBy("universe")
        .orderBy("vol_ann", "mean_ann")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    so_far = F.max("mean_ann").over(earlier)
    return (
        best.withColumn("_best", so_far)
        .filter("_best IS NULL OR mean_ann >= _best - 1e-12")
        .drop("_best")
    )


def weights_table(
    weights: DataFrame, chosen: DataFrame, min_weight: float = 1e-6
) -> DataFrame:
    """Weights of the chosen portfolios with the portfolio's figures on every row."""
    return (
        weights.join(chosen, PORTFOLIO)
        .filter(F.col("weight") >= min_weight)
        .orderBy("universe", "objective", F.desc("weight"), "symbol")
    )
