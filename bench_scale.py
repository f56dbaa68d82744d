"""Throughput of merging and resampling as the bars grow, one instrument holding a third.

The minute bars of BENCH_SF_DIR are copied to later months; every third copy
goes to one hot instrument, the others to many. Prints one JSON line per size.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def grown(bars: DataFrame, copies: int) -> DataFrame:
    """Copies shifted by 31 days each; two loads, the second repeating every third minute."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    many = bars.repartition(64).select("*", copy)
    name = F.when(F.col("copy") % 3 == 0, "HOT").otherwise(
        F.concat("symbol", F.col("copy") % 40)
    )
    # The five event types share the hot name, so each takes its own span of years.
    lane = F.when(F.col("copy") % 3 == 0, F.abs(F.hash("instrument_key")) % 1000).otherwise(0)
    shift = F.make_dt_interval(F.col("copy") * 31 + lane * 31 * copies)
    moved = (
        many.withColumn("symbol", name)
        .withColumn("window_start", F.col("window_start") + shift)
        .withColumn("session_end_date", F.to_date("window_start"))
        .withColumn("instrument_key", F.concat(F.lit("futures:"), F.col("symbol")))
        .withColumn("ticker", F.col("symbol"))
        .drop("copy")
    )
    again = moved.filter(F.minute("window_start") % 3 == 0)
    return moved.withColumn("run_id", F.lit("20240201T000000")).unionByName(
        again.withColumn("run_id", F.lit("20240208T000000"))
    )


def main() -> None:
    from barloom.operators.filters import latest_page
    from barloom.operators.merge import merge_runs
    from barloom.operators.resample import resample_minutes
    from barloom.operators.roll import dedupe_timestamps
    from barloom.session import build_session, materialize
    from workload.derive import minute_bars

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sizes = [int(n) for n in os.environ.get("BENCH_COPIES", "10,100").split(",")]
    spark = build_session(
        "bench-scale",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": "64", "spark.ui.enabled": "false",
           "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    steps = {
        "merge_runs": lambda runs, bars: merge_runs(runs),
        "dedupe_timestamps": lambda runs, bars: dedupe_timestamps(bars),
        "resample_30m": lambda runs, bars: resample_minutes(bars, 30),
        "latest_page_50000": lambda runs, bars: latest_page(bars, 50_000),
    }
    for copies in sizes:
        runs = materialize(grown(minute_bars(spark, sf), copies), "grown-runs")
        bars = materialize(merge_runs(runs), "grown-bars")
        counts = {"runs": runs.count(), "bars": bars.count()}
        hot = bars.filter("symbol = 'HOT'").count()
        out = {"copies": copies, **counts, "hot_share": round(hot / counts["bars"], 3)}
        for name, step in steps.items():
            start = time.perf_counter()
            step(runs, bars).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - start
            rows = counts["runs"] if name == "merge_runs" else counts["bars"]
            out[name] = {"sec": round(seconds, 2), "rows_per_sec": int(rows / seconds)}
        print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
