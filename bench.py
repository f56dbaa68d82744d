"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the local cores. BENCH_QUERIES may
name other registered queries (comma separated, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "merge_runs",
    "merge_report",
    "session_bars_60m",
    "session_bars_7m",
    "intraday_bars_chicago_15m",
    "weekly_bars",
    "three_day_bars",
    "adjust_splits",
    "adjust_dividends",
    "query_adjusted_weeks",
    "adjust_rolls",
    "dedupe_timestamps",
    "normalize_ticks",
    "tick_quality",
    "query_continuous_30m",
    "coverage",
    "health_issues",
    "latest_page",
    "distinct_values",
    "search_by_text",
    "describe_types",
    "price_panel",
    "returns_simple",
    "asset_stats",
    "correlation_matrix",
    "portfolio_performance",
    "efficient_frontier",
    "lots_table",
    "basket_weeks",
    "land_v2_bars",
    "land_chart_bars",
    "read_merged_bars",
    "stream_merge_runs",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from barloom.session import build_session, materialize
    from workload.derive import daily_bars, minute_bars
    from workload.registry import registered

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    known = registered()
    names = list(known) if asked == "all" else [q for q in asked.split(",") if q] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the session, the Parquet reader and writer and one Python worker, and compile the
    # derivation of the bars, before the clock runs
    spark.read.parquet(f"{sf}/region.parquet").mapInPandas(
        lambda batches: batches, "r_regionkey int, r_name string"
    ).count()
    for bars in (minute_bars(spark, sf), daily_bars(spark, sf)):
        materialize(bars, "warm-up").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
