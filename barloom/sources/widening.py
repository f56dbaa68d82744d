"""Raw runs whose files disagree on column types, read as one table.

A census of the footers tells the types of every file's columns. Files of one
schema are read together with the types they have, and each column is widened
to one that holds the values of all files: whole numbers to BIGINT, numbers of
different kinds to DOUBLE, times of nanoseconds to microseconds (rounded down),
anything else that differs to STRING. Columns that some files lack are null
there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.store import SEQUENCE

PARTITIONED_BY = ["run_id", "instrument_type", "resolution", "month"]
_NANOS = "timestamp_nanos"
_WHOLE = ["tinyint", "smallint", "int", "bigint"]


def _kind(kind: pa.DataType) -> str:
    """The Spark type under which a column of the given type is read."""
    if pa.types.is_timestamp(kind):
        if kind.unit == "ns":
            return _NANOS
        return "timestamp" if kind.tz else "timestamp_ntz"
    if pa.types.is_decimal(kind):
        return f"decimal({kind.precision},{kind.scale})"
    for test, name in (
        (pa.types.is_boolean, "boolean"),
        (pa.types.is_date, "date"),
        (pa.types.is_float32, "float"),
        (pa.types.is_float64, "double"),
        (pa.types.is_int8, "tinyint"),
        (pa.types.is_int16, "smallint"),
        (pa.types.is_int32, "int"),
        (pa.types.is_int64, "bigint"),
        (pa.types.is_string, "string"),
        (pa.types.is_large_string, "string"),
        (pa.types.is_null, "int"),
    ):
        if test(kind):
            return name
    raise ValueError(f"columns of type {kind} can't be read as bars")


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyarrow import parquet as pq

    for batch in batches:
        found: dict[str, list] = {"path": [], "columns": []}
        for path in batch.column("path").to_pylist():
            files, inside = fs.FileSystem.from_uri(path)
            schema = pq.read_schema(inside, filesystem=files)
            found["path"].append(path)
            found["columns"].append(
                "\n".join(f"{name}\t{_kind(kind)}" for name, kind in zip(schema.names, schema.types))
            )
        yield pa.RecordBatch.from_pydict(found)


def footer_census(spark: SparkSession, root: str) -> DataFrame:
    """(path, columns) of every file: a line ``name<TAB>type`` per column, from its footer."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    return files.repartition("path").mapInArrow(_read_footers, "path string, columns string")


def widest(kinds: set[str]) -> str:
    """The type that holds the values of all the given ones."""
    kinds = {"timestamp_ntz" if k == _NANOS else k for k in kinds}
    if len(kinds) == 1:
        (only,) = kinds
        return only if only not in _WHOLE else "bigint"
    if kinds <= set(_WHOLE):
        return "bigint"
    if kinds <= {*_WHOLE, "float", "double"} or all(
        k in (*_WHOLE, "float", "double") or k.startswith("decimal") for k in kinds
    ):
        return "double"
    if kinds <= {"date", "timestamp_ntz"}:
        return "timestamp_ntz"
    return "string"


def _widened(name: str, kind: str | None, to: str) -> Column:
    if kind is None:
        return F.lit(None).cast(to).alias(name)
    column = F.col(f"`{name}`")
    if kind == _NANOS:
        # div cuts towards zero
        micros = F.expr(f"`{name}` div 1000 - if(`{name}` % 1000 < 0, 1, 0)")
        column = F.timestamp_micros(micros).cast("timestamp_ntz")
    return column.cast(to).alias(name)


def read_widened(
    spark: SparkSession, root: str, partitioned_by: list[str] | None = None
) -> DataFrame:
    """All rows below ``root``, every column with the widest type that it has in a file.

    The driver holds the names of the files, as for any table it lists. A root
    without files is an error.
    """
    folders = PARTITIONED_BY if partitioned_by is None else partitioned_by
    groups = (
        footer_census(spark, root)
        .groupBy("columns")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .orderBy("columns")
        .collect()
    )
    if not groups:
        raise ValueError(f"no files below {root}")
    schemas = [dict(line.split("\t") for line in g["columns"].split("\n")) for g in groups]
    names = list(dict.fromkeys(name for schema in schemas for name in schema))
    types = {n: widest({schema[n] for schema in schemas if n in schema}) for n in names}
    parts = []
    for group, schema in zip(groups, schemas):
        fields = [f"`{n}` {'bigint' if k == _NANOS else k}" for n, k in schema.items()]
        fields += [f"`{folder}` string" for folder in folders]
        rows = (
            spark.read.schema(T.StructType.fromDDL(", ".join(fields)))
            .option("basePath", root)
            .parquet(*group["paths"])
        )
        parts.append(rows.select(*[_widened(n, schema.get(n), types[n]) for n in names], *folders))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def read_widened_runs(spark: SparkSession, root: str) -> DataFrame:
    """:func:`store.read_runs` for runs of differing types, with the columns the files have.

    Rows of a run saved elsewhere may lack their order inside the run; it is
    null there.
    """
    rows = read_widened(spark, root)
    if SEQUENCE not in rows.columns:
        rows = rows.withColumn(SEQUENCE, F.lit(None).cast("bigint"))
    return rows
