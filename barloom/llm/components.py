"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import stored


#: Parts into which the neighbours of a node are dealt.
PARTS = 128


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, m) with the smallest neighbour m of a, and the nodes (a, m).

    The minimum is taken per part of a node's neighbours, then over its parts,
    and goes back to the parts: no task gets all neighbours of a hub.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    nodes = parts.groupBy("a").agg(F.min("m").alias("m"))
    told = parts.select("a", "part").join(nodes, "a")
    return dealt.join(told, ["a", "part"]).select("a", "b", "m"), nodes


def _large(edges: DataFrame) -> DataFrame:
    """Greater neighbours of every node move to its smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known, _ = _with_least(both)
    moved = known.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return moved.where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    known, nodes = _with_least(edges)
    moved = known.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(nodes.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has a smaller one in its component, with the smallest.

    ``edges`` has columns a and b of one orderable type, without nulls; loops and
    repeats are allowed. Every round is written to the shared folder; the driver
    sees two numbers of it. Stars stay as they are, so rounds end when nothing
    moves.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stored(edges.select(a, b).where("a != b").distinct(), "components")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark or state[0] == 0:
            return now
        mark = state
        now = stored(_small(_large(now)), "components")
