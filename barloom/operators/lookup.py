"""Joining bar-sized tables to small side tables.

The side is broadcast where Spark's estimate of its bytes, or of a table that
bounds its rows, is below ``spark.sql.autoBroadcastJoinThreshold``; no job runs
to find out. Beyond that both sides are shuffled on the key plus a salt, so that one instrument holding
a large share of the bars is still spread over many tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def estimated_bytes(side: DataFrame) -> int:
    """The optimiser's estimate of a table's size; nothing is computed."""
    return int(str(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(side: DataFrame, max_bytes: int | None = None) -> bool:
    """Is the side below the given size, or else Spark's own threshold?"""
    if max_bytes is None:
        threshold = side.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
        unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        text = threshold.lower().rstrip("b")
        max_bytes = int(text[:-1]) * unit[text[-1]] if text[-1] in unit else int(text)
    return estimated_bytes(side) <= max_bytes


def lookup_join(
    facts: DataFrame,
    side: DataFrame,
    on: list[str],
    *,
    condition: Column | None = None,
    how: str = "left",
    bounded_by: DataFrame | None = None,
    spread_by: list[str] | None = None,
    max_bytes: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join on ``on`` plus an optional extra condition on side columns.

    ``bounded_by`` is a table known to have at least as many rows as ``side``
    and a better estimate of its size. ``spread_by`` names the fact columns
    whose hash is the salt (default: all of them). ``max_bytes`` replaces
    Spark's threshold.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join supports left and inner, not {how}")
    renamed = {c: f"_side_{c}" for c in on}
    small = side.withColumnsRenamed(renamed)
    match = [F.col(c) == F.col(renamed[c]) for c in on]
    if condition is not None:
        match.append(condition)
    sides = [side] if bounded_by is None else [side, bounded_by]
    if any(fits_broadcast(x, max_bytes) for x in sides):
        joined = facts.join(F.broadcast(small), reduce(and_, match), how)
        return joined.drop(*renamed.values())
    spread = [F.col(c) for c in (spread_by or facts.columns)]
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    small = small.withColumn("_side_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match.append(F.col("_salt") == F.col("_side_salt"))
    joined = salted.join(small, reduce(and_, match), how)
    return joined.drop(*renamed.values(), "_salt", "_side_salt")
