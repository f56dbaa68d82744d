"""Asset statistics and covariance / correlation matrices in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.lookup import lookup_join
from barloom.schema import RIDGE

SYMBOLS_PER_BLOCK = 128
PAIRS = "universe string, symbol_a string, symbol_b string, cov double, corr double, n_obs long"


def asset_stats(
    rets: DataFrame, periods: float, risk_free_rate: float | str = 0.04
) -> DataFrame:
    """Annualised mean, volatility and Sharpe per symbol (null for no volatility)."""
    rate = F.col(risk_free_rate) if isinstance(risk_free_rate, str) else F.lit(risk_free_rate)
    stats = rets.groupBy("universe", "symbol").agg(
        (F.avg("ret") * periods).alias("mean_ann"),
        (F.stddev_samp("ret") * float(np.sqrt(periods))).alias("vol_ann"),
        F.count("*").alias("n_obs"),
    )
    sharpe = F.when(
        F.col("vol_ann") > 1e-15, (F.col("mean_ann") - rate) / F.col("vol_ann")
    )
    return stats.withColumn("sharpe", sharpe)


def rank_stats(stats: DataFrame) -> DataFrame:
    """Output order: best Sharpe first, symbols without one last."""
    return stats.orderBy("universe", F.desc_nulls_last("sharpe"), "symbol")


def _block_moments():
    """Task function as a closure, so that executors need not have this package."""

    def block_pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Moments between the symbols of two blocks, from their return series."""
        universe, left, right = key
        if rows["dates"].nunique() > 1:
            raise ValueError(f"universe {universe}: symbols have returns on different dates")
        matrix = np.vstack(rows["series"].to_numpy())
        centred = matrix - matrix.mean(axis=1, keepdims=True)
        n = matrix.shape[1]
        scale = np.sqrt((centred**2).sum(axis=1))
        block = rows["block"].to_numpy()
        first, second = np.flatnonzero(block == left), np.flatnonzero(block == right)
        product = centred[first] @ centred[second].T
        norm = np.outer(scale[first], scale[second])
        corr = np.divide(product, norm, out=np.full_like(product, np.nan), where=norm > 0)
        names = rows["symbol"].to_numpy()
        one, other = np.repeat(names[first], len(second)), np.tile(names[second], len(first))
        swapped = one > other
        out = pd.DataFrame(
            {
                "universe": universe,
                "symbol_a": np.where(swapped, other, one),
                "symbol_b": np.where(swapped, one, other),
                "cov": (product / (n - 1)).ravel(),
                "corr": corr.ravel(),
                "n_obs": n,
            }
        )
        # inside one block every pair comes twice
        return out if left != right else out[~swapped]

    return block_pair


def pair_moments(rets: DataFrame, symbols_per_block: int = SYMBOLS_PER_BLOCK) -> DataFrame:
    """Sample covariance and correlation of every pair ``symbol_a <= symbol_b`` of a universe.

    Each symbol's returns travel as one array (a universe shares its dates, which
    a hash of them proves), and
    symbols are hashed into blocks of bounded size. A task holds two blocks and
    multiplies them, so the data are copied once per block instead of once per
    pair, and no task sees a whole universe.
    """
    point = F.struct("date", "ret")
    series = (
        rets.groupBy("universe", "symbol")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .select(
            "universe",
            "symbol",
            F.transform("points", lambda p: p.ret).alias("series"),
            F.xxhash64(F.transform("points", lambda p: p.date)).alias("dates"),
        )
    )
    sizes = (
        rets.groupBy("universe", "symbol")
        .agg(F.count("*").alias("_n"))
        .groupBy("universe")
        .agg(F.ceil(F.count("*") / symbols_per_block).cast("int").alias("_blocks"))
    )
    blocked = lookup_join(series, sizes, ["universe"], how="inner").withColumn(
        "block", F.pmod(F.xxhash64("symbol"), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    copies = blocked.withColumn("_other", other).select(
        "universe",
        "symbol",
        "block",
        F.least("block", "_other").alias("left"),
        F.greatest("block", "_other").alias("right"),
        "series",
        "dates",
    )
    return copies.groupBy("universe", "left", "right").applyInPandas(_block_moments(), PAIRS)


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both triangles of a matrix of which one is stored."""
    turned = {"symbol_a": "symbol_b", "symbol_b": "symbol_a"}
    swapped = pairs.filter("symbol_a <> symbol_b").select(
        *[F.col(turned.get(c, c)).alias(c) for c in pairs.columns]
    )
    return pairs.unionByName(swapped)


def covariance_matrix(moments: DataFrame, periods: float | None = None) -> DataFrame:
    """Upper triangle of the covariance matrix, annualised when periods are given."""
    value = F.col("cov") if periods is None else F.col("cov") * periods
    return moments.select("universe", "symbol_a", "symbol_b", value.alias("cov"))


def correlation_matrix(moments: DataFrame) -> DataFrame:
    return moments.select("universe", "symbol_a", "symbol_b", "corr")


def regularized(cov: DataFrame) -> DataFrame:
    """Covariance with a small ridge on the diagonal, for weight search only."""
    ridge = F.when(F.col("symbol_a") == F.col("symbol_b"), RIDGE).otherwise(0.0)
    return cov.withColumn("cov", F.col("cov") + ridge)
