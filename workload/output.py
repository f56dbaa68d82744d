"""One column list per query, applied alike on the Spark and on the SQL side.

An entry is ``name`` or ``name:how``: ``:s`` writes dates and times as text,
``:N`` rounds to N decimals. Rounding shifts ties upward by a hair, so that
both engines agree where sums differ in their last bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entries(spec: str) -> list[tuple[str, str]]:
    return [tuple((e + ":").split(":")[:2]) for e in spec.split()]


def spark_output(df: DataFrame, spec: str) -> DataFrame:
    def column(name: str, how: str) -> Column:
        if how == "s":
            return F.col(name).cast("string").alias(name)
        if how:
            scale = 10.0 ** int(how)
            return (F.floor(F.col(name) * scale + 0.5001) / scale).alias(name)
        return F.col(name)

    return df.select(*[column(*e) for e in _entries(spec)])


def sql_output(query: str, spec: str) -> str:
    def column(name: str, how: str) -> str:
        if how == "s":
            return f'CAST("{name}" AS VARCHAR) AS "{name}"'
        if how:
            return f'floor("{name}" * 1e{how} + 0.5001) / 1e{how} AS "{name}"'
        return f'"{name}"'

    columns = ", ".join(column(*e) for e in _entries(spec))
    return f"SELECT {columns} FROM (\n{query}\n) AS result"
