"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import materialize, scratch_path

#: One run of the white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session, the unit in which blocks are planned."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def key_of(column: str | Column) -> Column:
    """An id as a joinable text: nulls are one value of their own."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def free_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, with as many underscores in front as it needs to clash with no given column."""
    known = {name.lower() for name in taken}
    while wish.lower() in known:
        wish = f"_{wish}"
    return wish


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder; lost executors lose nothing of it."""
    return materialize(df, name)


__all__ = [
    "SPACES", "WORD", "free_name", "key_of", "partitions", "scratch_path", "stored", "table",
    "text_of",
]
