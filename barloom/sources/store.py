"""Parquet tables of the store: raw runs, merged bars, manifest and exports.

Bars are partitioned by instrument type, resolution and month, so that a query
prunes to what it reads and a merge rewrites only the months it touched. Inside,
ranges of (symbol, time) are sorted into files: row-group statistics prune the
symbol, a symbol that fills a month spreads over several files, and the number
of files grows with the data, not with the number of symbols. A write goes into
folders of its own version, which the manifest then names all at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.instruments import instrument_key
from barloom.operators.merge import merge_report
from barloom.schema import BARS, KEY
from barloom.sources import manifest as log
from barloom.sources.manifest import PARTITIONS

#: Order of the rows of a run, kept so that repeats inside it can be told apart later.
SEQUENCE = "row_index"
_STORED = [f for f in BARS.fields if f.name not in (KEY, *PARTITIONS)]
STORED = T.StructType(
    [
        *_STORED,
        T.StructField(SEQUENCE, T.LongType()),
        *[T.StructField(c, T.StringType()) for c in PARTITIONS],
    ]
)
#: Raw runs: the run is the outermost partition.
RUNS = T.StructType(
    [f for f in STORED.fields if f.name not in ("run_id", *PARTITIONS)]
    + [T.StructField(c, T.StringType()) for c in ("run_id", *PARTITIONS)]
)


def conform(bars: DataFrame, *more: str) -> DataFrame:
    """Bars with the fixed schema: missing columns become null, extra ones but ``more`` go."""
    columns = []
    for field in BARS.fields:
        source = F.col(field.name) if field.name in bars.columns else F.lit(None)
        columns.append(source.cast(field.dataType).alias(field.name))
    named = bars.select(*columns, *more)
    key = instrument_key(F.col("instrument_type"), F.col("symbol"))
    return named.withColumn(KEY, F.coalesce(KEY, key)).withColumn(
        "product_code", F.coalesce("product_code", "symbol")
    )


def with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format("window_start", "yyyy-MM"))


def _in_files(stored: DataFrame) -> DataFrame:
    """Sorted ranges; a task writes neighbouring symbols, so into few folders."""
    order = [*PARTITIONS, "symbol", "window_start"]
    return stored.repartitionByRange(*order).sortWithinPartitions(*order)


def save_run(bars: DataFrame, root: str, run_id: str) -> None:
    """Store one immutable run; an existing run id is an error.

    The id is part of the path and cannot change later. Rows are numbered in
    the order in which they come. The manifest gets the run's statistics.
    """
    numbered = conform(bars).withColumn(SEQUENCE, F.monotonically_increasing_id())
    stored = with_month(numbered).drop("run_id", KEY)
    _in_files(stored).write.mode("errorifexists").partitionBy(*PARTITIONS).parquet(
        f"{root}/run_id={run_id}"
    )
    record_run(bars.sparkSession, root, run_id)


def record_run(spark: SparkSession, root: str, run_id: str) -> None:
    """Add a stored run to the manifest; needed by hand only if saving it died in between."""
    rows = spark.read.schema(RUNS).option("basePath", root).parquet(f"{root}/run_id={run_id}")
    log.append(log.statistics(_keyed(rows), F.lit(run_id)), root)


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of all saved runs."""
    return log.live(log.entries(spark, root), by=["run_id"])


def bars_log(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of the merged bars as they are now."""
    return log.live(log.entries(spark, root))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All raw runs as one table; ``row_index`` keeps the order inside a run.

    ``run_id`` is a partition column, so a filter on it prunes folders. Columns
    a run lacks are null.
    """
    return as_bars(spark.read.schema(RUNS).parquet(root))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(KEY, instrument_key(F.col("instrument_type"), F.col("symbol")))


def as_bars(rows: DataFrame) -> DataFrame:
    """Stored rows with the columns of bars and their order inside the run."""
    return (
        _keyed(rows)
        .withColumn("product_code", F.coalesce("product_code", "symbol"))
        .select(*[f.name for f in BARS.fields], SEQUENCE)
    )


def write_bars(bars: DataFrame, root: str) -> None:
    """Replace the touched partitions, all at once; files hold sorted ranges of (symbol, time).

    The bars may come from the table itself: its files stay as they are until
    someone clears what ``manifest.replaced_parts`` lists.
    """
    sequence = F.col(SEQUENCE) if SEQUENCE in bars.columns else F.lit(None).cast("long")
    columns = [F.col(c) for c in bars.columns if c != SEQUENCE]
    numbered = bars.select(*columns, sequence.alias(SEQUENCE))
    stored = with_month(conform(numbered, SEQUENCE)).drop(KEY)
    version = uuid.uuid4().hex
    folder = f"{root}/version={version}"
    _in_files(stored).write.partitionBy(*PARTITIONS).parquet(folder)
    written = _keyed(bars.sparkSession.read.schema(STORED).parquet(folder))
    log.append(log.statistics(written, F.lit(version)), root)


def read_bars(
    spark: SparkSession,
    root: str,
    *,
    instrument_type: str | None = None,
    symbols: list[str] | None = None,
    resolution: str | None = None,
    months: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Merged bars of one state of the table; the arguments prune partitions.

    ``months`` are the first and the last month, as ``yyyy-MM``.
    """
    parts = log.live_parts(
        spark, root, instrument_type=instrument_type, resolution=resolution, months=months
    )
    bars = _keyed(_read_parts(spark, root, parts))
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(symbols))
    return bars.select(*[f.name for f in BARS.fields])


def _read_parts(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], STORED)
    versioned = T.StructType([*STORED.fields, T.StructField("version", T.StringType())])
    return spark.read.schema(versioned).option("basePath", root).parquet(*parts).drop("version")


def touched_months(bars: DataFrame) -> DataFrame:
    return with_month(bars).select(*PARTITIONS).distinct()


def bars_in_partitions(spark: SparkSession, root: str, touched: DataFrame) -> DataFrame:
    """Stored bars of the given partitions only, with their order inside their run.

    The partitions, at most a few hundred, choose the folders that are read.
    """
    wanted = [tuple(r) for r in touched.select(*PARTITIONS).distinct().collect()]
    return as_bars(_read_parts(spark, root, log.live_parts(spark, root, among=wanted)))


def manifest(runs: DataFrame, *, fetched_at: str) -> DataFrame:
    """One row per instrument and resolution: counts, range, source, duplicates removed."""
    return _described(merge_report(runs), fetched_at)


def stored_manifest(
    spark: SparkSession, runs_root: str, bars_root: str, *, fetched_at: str
) -> DataFrame:
    """The same from what was counted when runs and bars were written; no bar is read."""
    numbers = log.merge_numbers(run_log(spark, runs_root), bars_log(spark, bars_root))
    return _described(numbers, fetched_at)


def _described(numbers: DataFrame, fetched_at: str) -> DataFrame:
    source = F.when(F.col("resolution") == "1day", "daily").otherwise("minute")
    return numbers.withColumn("source", source).withColumn("last_fetched_at", F.lit(fetched_at))


def column_manifest(rows: DataFrame) -> DataFrame:
    """Non-null count and type of every column of a dataset."""
    names = rows.columns
    kinds = dict(rows.dtypes)
    counts = rows.agg(*[F.count(F.col(c)).alias(c) for c in names])
    types = F.create_map(*[F.lit(x) for c in names for x in (c, kinds[c])])
    return counts.unpivot([], names, "column", "non_null").withColumn(
        "dtype", F.element_at(types, F.col("column"))
    )


def export_frame(rows: DataFrame, path: str) -> None:
    """CSV with a header for ``.csv``, Parquet for everything else."""
    if path.lower().endswith(".csv"):
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)
