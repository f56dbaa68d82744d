"""What is loaded, what is due: run catalogue, load windows, prerequisites, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.clock import month_horizon
from barloom.operators.lookup import lookup_join
from barloom.operators.roll import overlapping_segments
from barloom.schema import (
    DAILY_TYPES,
    DAY,
    DAYS_PER_MONTH,
    HISTORY_MONTHS,
    KEY,
    MINUTE,
    OVERLAP_DAYS,
)


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def run_catalog(runs: DataFrame) -> DataFrame:
    """One row per instrument, ticker, resolution and run."""
    return runs.groupBy(KEY, "ticker", "resolution", "run_id").agg(
        F.count("*").alias("row_count"),
        F.min("window_start").alias("window_start_min"),
        F.max("window_start").alias("window_start_max"),
    )


def run_overview(catalog: DataFrame, today: str) -> DataFrame:
    """Per instrument and resolution: tickers, runs, latest run date, run done today."""
    stamp = F.date_format(_date(today), "yyyyMMdd")
    per_ticker = catalog.groupBy(KEY, "resolution", "ticker").agg(
        F.count("*").alias("runs"),
        F.max("run_id").alias("latest"),
        F.count_if(F.startswith("run_id", stamp)).alias("runs_today"),
    )
    return per_ticker.groupBy(KEY, "resolution").agg(
        F.count("*").alias("ticker_count"),
        F.sum("runs").alias("run_count"),
        F.substring(F.max("latest"), 1, 8).alias("latest_run_date"),
        (F.sum("runs_today") > 0).alias("done_today"),
    )


def snapshot_dates(
    products: DataFrame, today: str, *, interval_months: int, months: int = HISTORY_MONTHS["futures"]
) -> DataFrame:
    """Dates to list contracts at: today and every interval (30-day months) back."""
    back = range(0, months + 1, interval_months) if interval_months > 0 else [0]
    days = F.array(*[F.lit(m * DAYS_PER_MONTH) for m in back])
    return products.select(
        "product_code", F.explode(days).alias("_back")
    ).select("product_code", F.date_sub(_date(today), F.col("_back")).alias("snapshot_date"))


def _horizon(today: str) -> Column:
    months = F.create_map(*[F.lit(x) for kv in HISTORY_MONTHS.items() for x in kv])
    return month_horizon(_date(today), F.element_at(months, F.col("instrument_type")))


def futures_load_plan(
    instruments: DataFrame, chain: DataFrame, coverage: DataFrame, today: str
) -> DataFrame:
    """Date range to load per contract segment that overlaps the history horizon."""
    day = _date(today)
    wanted = (
        instruments.filter("instrument_type = 'futures'")
        .withColumns({"start_date": _horizon(today), "end_date": day})
        .select(KEY, "start_date", "end_date")
    )
    held = coverage.filter(F.col("resolution") == MINUTE).select(
        KEY, F.col("max_date").alias("_latest")
    )
    overlap = F.date_sub(F.col("_latest"), OVERLAP_DAYS[MINUTE])
    return (
        overlapping_segments(wanted, chain)
        .join(held, KEY, "left")
        .withColumn(
            "load_from",
            F.greatest(F.least("start_date", overlap), F.col("active_from")),
        )
        .withColumn("load_to", F.least("end_date", "active_until"))
        .filter("load_from <= load_to")
        .select(KEY, "ticker", F.lit(MINUTE).alias("resolution"), "load_from", "load_to")
    )


def single_load_plan(
    instruments: DataFrame, coverage: DataFrame, today: str, resolution: str = MINUTE
) -> DataFrame:
    """Date range per single-symbol instrument; a null start is the full daily history."""
    day = _date(today)
    kinds = ["stocks", "forex", "indices"] if resolution == MINUTE else DAILY_TYPES
    first = _horizon(today) if resolution == MINUTE else F.lit(None).cast("date")
    held = coverage.filter(F.col("resolution") == resolution).select(
        KEY, F.col("max_date").alias("_latest")
    )
    start = F.when(F.col("_latest").isNull(), first).otherwise(
        F.date_sub(F.col("_latest"), OVERLAP_DAYS[resolution])
    )
    return (
        instruments.filter(F.col("instrument_type").isin(kinds))
        .join(held, KEY, "left")
        .select(
            KEY,
            F.col("symbol").alias("ticker"),
            F.lit(resolution).alias("resolution"),
            start.alias("load_from"),
            day.alias("load_to"),
        )
        .filter("load_from IS NULL OR load_from <= load_to")
    )


def skip_loaded(plan: DataFrame, catalog: DataFrame, today: str) -> DataFrame:
    """Drop planned loads whose ticker already has a run of today."""
    stamp = F.date_format(_date(today), "yyyyMMdd")
    done = (
        catalog.filter(F.startswith("run_id", stamp)).select(KEY, "ticker", "resolution").distinct()
    )
    return plan.join(done, [KEY, "ticker", "resolution"], "left_anti")


def prerequisites(
    instruments: DataFrame,
    *,
    contracts: DataFrame,
    splits: DataFrame,
    dividends: DataFrame,
    catalog: DataFrame,
    coverage: DataFrame,
) -> DataFrame:
    """Which steps each instrument still needs before it can be queried.

    Futures need a contract list, stocks their splits and dividends; every
    instrument needs runs and merged bars on the minute track, and those with
    a daily track on that one too.
    """

    def present(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(KEY).distinct().withColumn(name, F.lit(True))

    listed = contracts.select(
        F.concat(F.lit("futures:"), F.col("product_code")).alias(KEY)
    )
    parts = {
        "has_contracts": listed,
        "has_splits": splits,
        "has_dividends": dividends,
        "has_runs_1min": catalog.filter(F.col("resolution") == MINUTE),
        "has_runs_1day": catalog.filter(F.col("resolution") == DAY),
        "has_bars_1min": coverage.filter(F.col("resolution") == MINUTE),
        "has_bars_1day": coverage.filter(F.col("resolution") == DAY),
    }
    out = instruments
    for name, rows in parts.items():
        out = out.join(present(rows, name), KEY, "left").withColumn(
            name, F.coalesce(name, F.lit(False))
        )
    kind = F.col("instrument_type")
    listing = (
        F.when(kind == "futures", F.col("has_contracts"))
        .when(kind == "stocks", F.col("has_splits") & F.col("has_dividends"))
        .otherwise(F.lit(True))
    )
    missing = (
        F.when(~listing, "listing")
        .when(~F.col("has_runs_1min"), "load")
        .when(~F.col("has_bars_1min"), "merge")
    )
    return out.withColumn("has_listing", listing).withColumn("missing_step", missing)


def freshness(
    manifest: DataFrame, now: str, ttl_days: float, *, inclusive: bool = False
) -> DataFrame:
    """Flag rows whose last fetch is younger than the time to live.

    Missing or unreadable times are stale. Times without a zone are UTC.
    ``inclusive`` also accepts an age of exactly the limit (risk-free quotes).
    """
    moment = F.try_to_timestamp(F.col("last_fetched_at").cast("string"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(moment)
    limit = int(ttl_days * 86_400_000_000)
    young = (age <= limit) if inclusive else (age < limit)
    return manifest.withColumn("is_fresh", F.coalesce(young, F.lit(False)))
