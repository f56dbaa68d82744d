"""Backtest overlays: transactions and orders drawn over a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _iso(name: str, rows: DataFrame) -> Column:
    """ISO-8601 text; naive times are UTC and get a ``Z``; a fraction is kept where there is one."""
    moment = F.col(name)
    if dict(rows.dtypes)[name] == "string":
        return moment
    whole = F.date_trunc("second", moment.cast("timestamp")) == moment.cast("timestamp")
    return F.when(whole, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def list_overlays(backtests: DataFrame, instrument: str) -> DataFrame:
    """Overlay files of one instrument with their backtests and the one shown first.

    ``backtests`` has a row (stem, position, backtest_id, instrument) per entry of
    a file, and one without id for a file that has none. A file belongs to the
    instrument of its first entry, or to every instrument if that names none. All
    its ids are listed in their order; a file without entries lists itself.
    """
    entry = F.struct("position", "backtest_id")
    named = F.col("backtest_id").isNotNull()
    files = backtests.groupBy("stem").agg(
        F.coalesce(
            F.min_by("instrument", F.when(named, entry)), F.lit("")
        ).alias("_instrument")
    )
    ids = (
        backtests.filter(named)
        .groupBy("stem", "backtest_id")
        .agg(F.min("position").alias("position"))
        .groupBy("stem")
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.backtest_id).alias("ids"))
    )
    return (
        files.filter((F.col("_instrument") == "") | (F.col("_instrument") == instrument))
        .join(ids, "stem", "left")
        .withColumn("ids", F.coalesce("ids", F.array("stem")))
        .select(
            "stem",
            F.lit(instrument).alias("instrument"),
            "ids",
            F.element_at("ids", 1).alias("default_id"),
        )
    )


def load_transactions(transactions: DataFrame, backtest_id: str) -> DataFrame:
    rows = transactions.filter(F.col("backtest_id") == backtest_id)
    return rows.select(
        "backtest_id",
        _iso("time", rows).alias("time"),
        F.col("price").cast("double").alias("price"),
        "side",
        "kind",
    )


def load_orders(orders: DataFrame, backtest_id: str) -> DataFrame:
    rows = orders.filter(F.col("backtest_id") == backtest_id)
    return rows.select(
        "backtest_id",
        _iso("time_from", rows).alias("time_from"),
        _iso("time_to", rows).alias("time_to"),
        F.col("price").cast("double").alias("price"),
        "side",
        "order_type",
    )
