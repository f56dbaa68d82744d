"""Incremental merge of newly landed run files into the merged bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.merge import merge_runs
from barloom.schema import KEY
from barloom.sources.store import (
    PARTITIONS,
    RUNS,
    SEQUENCE,
    as_bars,
    bars_in_partitions,
    conform,
    touched_months,
    with_month,
    write_bars,
)
from barloom.streaming.bars import tumbling_bars

#: Run files of one batch, so that a first start over a long history is no single job.
FILES_PER_BATCH = 256


def landed_runs(
    spark: SparkSession, root: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """Stream of run files with the order of their rows inside the run."""
    reader = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", files_per_batch)
    return as_bars(reader.parquet(root))


def merge_batch(batch: DataFrame, bars_root: str) -> None:
    """Merge one batch into the months it touches and replace just those, all at once.

    A replayed batch finds its own rows already stored and changes nothing. The
    merged months are a new version; readers see them when the manifest names it.
    """
    if SEQUENCE not in batch.columns:
        batch = batch.withColumn(SEQUENCE, F.lit(None).cast("long"))
    fresh = conform(batch, SEQUENCE).persist()
    try:
        stored = bars_in_partitions(batch.sparkSession, bars_root, touched_months(fresh))
        write_bars(merge_runs(stored.unionByName(fresh)), bars_root)
    finally:
        fresh.unpersist()


def bars_batch(batch: DataFrame, bars_root: str, out_root: str, k_minutes: int) -> None:
    """Merge one batch, then replace the k-minute bars of the months it touches.

    The k-minute bars come from merged minutes, so the last run of a minute
    counts, and windows that may still grow are there as well.
    """
    merge_batch(batch, bars_root)
    touched = touched_months(batch)
    minutes = bars_in_partitions(batch.sparkSession, bars_root, touched)
    bars = tumbling_bars(minutes, k_minutes, by=[*PARTITIONS[:2], "symbol", KEY])
    (
        with_month(bars)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(out_root)
    )


def start_merge(
    runs: DataFrame, bars_root: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start the merge; by default it drains what has landed and stops."""
    return (
        runs.writeStream.foreachBatch(lambda batch, _id: merge_batch(batch, bars_root))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_bars(
    runs: DataFrame, bars_root: str, out_root: str, k_minutes: int, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start the merge together with the k-minute bars that follow from it."""
    return (
        runs.writeStream.foreachBatch(
            lambda batch, _id: bars_batch(batch, bars_root, out_root, k_minutes)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
