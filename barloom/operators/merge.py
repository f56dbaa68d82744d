"""Merging overlapping loads into one history, and contract snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.schema import KEY, VOLUMES

# The time leads: it decides most comparisons of the sort by its binary prefix.
BAR_KEY = ["window_start", KEY, "ticker", "resolution"]


def _newest_first(runs: DataFrame) -> list:
    order = [F.col("run_id").desc_nulls_last()]
    if "row_index" in runs.columns:
        order.append(F.col("row_index").desc_nulls_last())
    return order


def merge_runs(runs: DataFrame) -> DataFrame:
    """One row per bar key: the last row of the last run wins.

    The rank-one filter lets Spark prune to one row per key before the shuffle,
    and the key is a single minute, so no group grows with an instrument.
    """
    newest = W.partitionBy(*BAR_KEY).orderBy(*_newest_first(runs))
    ranked = runs.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
    return ranked.drop("_rank")


def merge_report(runs: DataFrame) -> DataFrame:
    """Rows before and after the merge, duplicates removed, runs surviving, range."""
    newest = W.partitionBy(*BAR_KEY).orderBy(*_newest_first(runs))
    kept = F.col("_rank") == 1
    per_run = (
        runs.withColumn("_rank", F.row_number().over(newest))
        .groupBy(KEY, "resolution", "run_id")
        .agg(
            F.count("*").alias("rows_read"),
            F.count_if(kept).alias("row_count"),
            F.min(F.when(kept, F.col("window_start"))).alias("window_start_min"),
            F.max(F.when(kept, F.col("window_start"))).alias("window_start_max"),
        )
    )
    return (
        per_run.groupBy(KEY, "resolution")
        .agg(
            F.sum("rows_read").alias("rows_read"),
            F.sum("row_count").alias("row_count"),
            F.count_if(F.col("row_count") > 0).alias("source_run_count"),
            F.min("window_start_min").alias("window_start_min"),
            F.max("window_start_max").alias("window_start_max"),
        )
        .withColumn("duplicates_removed", F.col("rows_read") - F.col("row_count"))
    )


def integer_range_report(bars: DataFrame) -> DataFrame:
    """Whether volume and transactions would fit a 32-bit integer, per instrument."""
    columns = [c for c in VOLUMES[:2] if c in bars.columns]
    out = bars.groupBy(KEY, "resolution").agg(
        *[
            agg(c).alias(f"{c}_{name}")
            for c in columns
            for name, agg in (("min", F.min), ("max", F.max))
        ]
    )
    for c in columns:
        fits = (F.col(f"{c}_min") >= -(2**31)) & (F.col(f"{c}_max") <= 2**31 - 1)
        out = out.withColumn(f"{c}_fits_int32", F.coalesce(fits, F.lit(False)))
    return out


def stamp_identity(bars: DataFrame, instruments: DataFrame, on: str = "symbol") -> DataFrame:
    """Add type, key and product code from the instruments table."""
    from barloom.operators.lookup import lookup_join

    identity = instruments.select(on, KEY, "instrument_type").distinct()
    bare = bars.drop(*[c for c in (KEY, "instrument_type") if c in bars.columns])
    out = lookup_join(bare, identity, [on], how="inner", bounded_by=instruments)
    return out.withColumn("product_code", F.col("symbol"))


def contract_history(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot row per contract, missing tick filled with the product's usual one."""
    latest = W.partitionBy("product_code", "ticker").orderBy(
        F.col("date").desc_nulls_last(), F.col("trade_tick_size").asc_nulls_last()
    )
    newest = (
        snapshots.withColumn("_rank", F.row_number().over(latest))
        .filter("_rank = 1")
        .drop("_rank")
    )
    outright = F.when(~F.contains("ticker", F.lit("-")), F.col("trade_tick_size"))
    usual = newest.groupBy("product_code").agg(F.mode(outright, True).alias("_usual_tick"))
    return (
        newest.join(usual, "product_code", "left")
        .withColumn("trade_tick_size", F.coalesce("trade_tick_size", "_usual_tick"))
        .drop("_usual_tick")
    )
