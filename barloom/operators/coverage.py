"""Coverage of the bars, expected grid, health issues and the status table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import CROSS_RESOLUTION_LAG_DAYS, DAILY_TYPES, DAY, KEY, MINUTE, STALE_LAG_DAYS


def coverage(bars: DataFrame, today: str) -> DataFrame:
    """Rows, date range and calendar lag per instrument and resolution."""
    return with_lag(
        bars.groupBy(KEY, "resolution").agg(
            F.count("*").alias("rows"),
            F.to_date(F.min("window_start")).alias("min_date"),
            F.to_date(F.max("window_start")).alias("max_date"),
        ),
        today,
    )


def with_lag(held: DataFrame, today: str) -> DataFrame:
    """Rows and ranges, for example those of a table's manifest, with lag and staleness."""
    lag = F.date_diff(F.lit(today).cast("date"), F.col("max_date"))
    return held.withColumn("lag_days", lag).withColumn("stale", is_stale())


def is_stale():
    limits = F.create_map(*[F.lit(x) for kv in STALE_LAG_DAYS.items() for x in kv])
    over = F.col("lag_days") > F.try_element_at(limits, F.col("resolution"))
    return F.coalesce(over, F.lit(False))


def expected_grid(instruments: DataFrame) -> DataFrame:
    """Resolutions each instrument should have: minutes always, days for four types."""
    both = F.array(F.lit(MINUTE), F.lit(DAY))
    tracks = F.when(F.col("instrument_type").isin(DAILY_TYPES), both).otherwise(
        F.array(F.lit(MINUTE))
    )
    return instruments.select(KEY, F.explode(tracks).alias("resolution"))


def health_issues(instruments: DataFrame, held: DataFrame) -> DataFrame:
    """Missing bars, stale bars and lag gaps between an instrument's resolutions."""
    cells = expected_grid(instruments).join(
        held.select(KEY, "resolution", "lag_days", "stale", "max_date"),
        [KEY, "resolution"],
        "left",
    )
    single = (
        cells.withColumn(
            "code",
            F.when(F.col("stale").isNull(), "missing_aggregate").when(F.col("stale"), "stale"),
        )
        .filter("code IS NOT NULL")
        .select(
            KEY,
            F.when(F.col("code") == "stale", "stale").otherwise("warn").alias("level"),
            "code",
            "resolution",
            "lag_days",
        )
    )
    lag_of = {r: F.max(F.when(F.col("resolution") == r, F.col("lag_days"))) for r in (MINUTE, DAY)}
    gap = F.abs(F.col("_minute") - F.col("_day"))
    across = (
        cells.groupBy(KEY)
        .agg(lag_of[MINUTE].alias("_minute"), lag_of[DAY].alias("_day"))
        .filter(gap > CROSS_RESOLUTION_LAG_DAYS)
        .select(
            KEY,
            F.lit("warn").alias("level"),
            F.lit("cross_resolution_lag").alias("code"),
            F.lit(None).cast("string").alias("resolution"),
            gap.alias("lag_days"),
        )
    )
    return single.unionByName(across)


def instrument_health(instruments: DataFrame, issues: DataFrame) -> DataFrame:
    """Worst level per instrument and whether it fails the normal and the strict check."""
    rank = F.when(F.col("level") == "stale", 2).otherwise(1)
    worst = issues.groupBy(KEY).agg(
        F.max(rank).alias("_rank"),
        F.count("*").alias("issue_count"),
        F.bool_or(F.col("level") == "stale").alias("_fails"),
    )
    level = F.when(F.col("_rank") == 2, "stale").when(F.col("_rank") == 1, "warn").otherwise("ok")
    return instruments.join(worst, KEY, "left").select(
        KEY,
        level.alias("worst_level"),
        F.coalesce("issue_count", F.lit(0)).alias("issue_count"),
        F.coalesce("_fails", F.lit(False)).alias("fails_check"),
        # every issue code counts in strict mode
        F.coalesce(F.col("issue_count") > 0, F.lit(False)).alias("fails_strict_check"),
    )


def status_table(
    instruments: DataFrame, held: DataFrame, catalog: DataFrame, contracts: DataFrame
) -> DataFrame:
    """One row per instrument and expected resolution: contracts, runs and coverage."""
    per_run = catalog.groupBy(KEY, "resolution").agg(
        F.count_distinct("ticker").alias("ticker_count"), F.count("*").alias("run_count")
    )
    listed = contracts.groupBy(
        F.concat(F.lit("futures:"), F.col("product_code")).alias(KEY)
    ).agg(F.count("*").alias("contract_count"))
    cells = (
        expected_grid(instruments)
        .join(held, [KEY, "resolution"], "left")
        .join(per_run, [KEY, "resolution"], "left")
        .join(listed, KEY, "left")
    )
    status = (
        F.when(F.col("rows").isNull(), "missing").when(F.col("stale"), "stale").otherwise("ok")
    )
    counts = ["rows", "ticker_count", "run_count", "contract_count"]
    return cells.withColumn("status", status).withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts}
    ).drop("stale")
