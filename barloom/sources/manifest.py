"""The log beside a stored table: which files count, and statistics that merge.

A table's files are written first, under a version of their own; then one entry is added to the log, a
single file that appears whole or not at all. Readers take, for each partition, the files that the
last entry names, so a write that dies half way changes nothing, and all months of a write change
together. An entry has one row of mergeable statistics for each partition, instrument, ticker and
run: catalogues, coverage, session bounds and the numbers of a merge are sums over the log, without a
look at the bars. One process writes a table at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import KEY

#: Folder of the log; its name hides it from readers of the table.
FOLDER = "_manifest"
PARTITIONS = ["instrument_type", "resolution", "month"]
#: What tells one row of an entry from another.
IDENTITY = [*PARTITIONS, KEY, "ticker", "run_id"]
LOG = T.StructType(
    [
        T.StructField("commit", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("version", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in IDENTITY],
        T.StructField("row_count", T.LongType()),
        T.StructField("window_start_min", T.TimestampNTZType()),
        T.StructField("window_start_max", T.TimestampNTZType()),
        T.StructField("first_date", T.DateType()),
        T.StructField("last_date", T.DateType()),
    ]
)


def statistics(rows: DataFrame, version: Column) -> DataFrame:
    """One row per partition, instrument, ticker and run of stored rows."""
    return rows.groupBy(version.alias("version"), *IDENTITY).agg(
        F.count("*").alias("row_count"),
        F.min("window_start").alias("window_start_min"),
        F.max("window_start").alias("window_start_max"),
        F.min("session_end_date").alias("first_date"),
        F.max("session_end_date").alias("last_date"),
    )


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the log since its last summary; none where nothing was ever written."""
    try:
        found = spark.read.schema(LOG).parquet(f"{root}/{FOLDER}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)
    since = found.where("whole").agg(F.max("commit")).first()[0]
    return found if since is None else found.where(F.col("commit") >= since)


def append(statistics: DataFrame, root: str, *, whole: bool = False) -> None:
    """Add one entry; as one file it is seen completely or not at all."""
    spark = statistics.sparkSession
    last = entries(spark, root).agg(F.max("commit")).first()[0]
    entry = statistics.withColumns(
        {"commit": F.lit(1 + (last or 0)).cast("bigint"), "whole": F.lit(whole)}
    )
    entry.select(*LOG.names).coalesce(1).write.mode("append").parquet(f"{root}/{FOLDER}")


def live(log: DataFrame, *, by: list[str] = PARTITIONS) -> DataFrame:
    """Rows of the last entry of each partition: what readers of the table see."""
    newest = F.max("commit").over(W.partitionBy(*by))
    return log.withColumn("_newest", newest).where("commit = _newest").drop("_newest")


def compact(spark: SparkSession, root: str, *, by: list[str] = PARTITIONS) -> None:
    """Add an entry that sums up the log, from which readers then start."""
    append(live(entries(spark, root), by=by).select(*LOG.names[2:]), root, whole=True)


def live_parts(
    spark: SparkSession,
    root: str,
    *,
    instrument_type: str | None = None,
    resolution: str | None = None,
    months: tuple[str | None, str | None] = (None, None),
    among: list[tuple] | None = None,
) -> list[str]:
    """Folders that hold the table's rows now: one for each type, track and month asked for."""
    log = entries(spark, root)
    if instrument_type is not None:
        log = log.where(F.col("instrument_type") == instrument_type)
    if resolution is not None:
        log = log.where(F.col("resolution") == resolution)
    first, last = months
    if first is not None:
        log = log.where(F.col("month") >= first)
    if last is not None:
        log = log.where(F.col("month") <= last)
    parts = live(log).select("version", *PARTITIONS).distinct().collect()
    wanted = None if among is None else set(among)
    return sorted(
        f"{root}/version={p.version}/instrument_type={p.instrument_type}"
        f"/resolution={p.resolution}/month={p.month}"
        for p in parts
        if wanted is None or (p.instrument_type, p.resolution, p.month) in wanted
    )


def replaced_parts(spark: SparkSession, root: str) -> list[str]:
    """Folders of the log that no reader takes any more, for whoever clears the table."""
    log = entries(spark, root)
    parts = log.select("version", *PARTITIONS).distinct()
    old = parts.join(live(log).select("version", *PARTITIONS).distinct(), parts.columns, "left_anti")
    return sorted(
        f"{root}/version={p.version}/instrument_type={p.instrument_type}"
        f"/resolution={p.resolution}/month={p.month}"
        for p in old.collect()
    )


def run_catalog(log: DataFrame) -> DataFrame:
    """One row per instrument, ticker, resolution and run, as counted when they were stored."""
    return log.groupBy(KEY, "ticker", "resolution", "run_id").agg(
        F.sum("row_count").alias("row_count"),
        F.min("window_start_min").alias("window_start_min"),
        F.max("window_start_max").alias("window_start_max"),
    )


def session_bounds(log: DataFrame) -> DataFrame:
    """First and last session per instrument and track."""
    return log.groupBy(KEY, "resolution").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )


def held_rows(log: DataFrame) -> DataFrame:
    """Rows and range of times per instrument and track."""
    return log.groupBy(KEY, "resolution").agg(
        F.sum("row_count").alias("rows"),
        F.to_date(F.min("window_start_min")).alias("min_date"),
        F.to_date(F.max("window_start_max")).alias("max_date"),
    )


def merge_numbers(runs: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows before and after the merge per instrument and track, from the logs of both tables."""
    read = runs.groupBy(KEY, "resolution").agg(F.sum("row_count").alias("rows_read"))
    kept = bars.groupBy(KEY, "resolution").agg(
        F.sum("row_count").alias("row_count"),
        F.count_distinct("run_id").alias("source_run_count"),
        F.min("window_start_min").alias("window_start_min"),
        F.max("window_start_max").alias("window_start_max"),
    )
    return kept.join(read, [KEY, "resolution"]).withColumn(
        "duplicates_removed", F.col("rows_read") - F.col("row_count")
    )
