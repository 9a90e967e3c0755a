"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (hi, lo), hi > lo. Large: neighbours above a node go to the least of its neighbourhood; small: those below do."""
    if large:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.where("v > u") if large else near
    moved = moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return (
        moved.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b of one integer type) that isn't its own root; root is the least node.

    Empty edges give an empty table; self-loops and repeated edges are ignored. Each round is written to the shared folder.
    """
    now = (
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    now = materialize(now, "edges")
    seal = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    before = seal(now)
    if before[0]:
        for _ in range(max_rounds):
            now = materialize(_star(_star(now, True), False), "edges")
            after = seal(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
