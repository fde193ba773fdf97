"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). All rounds are joins and
grouped minima: a node with very many neighbours is never collected, and since each round's minima
and edges are written tables, both sides of its join are plain exchanges whose large partitions Spark
can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import forget, keep


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's neighbours (larger ones in a large star, smaller ones in a small star) move to its least."""
    hood = _both_ways(edges)
    if not large:
        hood = hood.where("v < u")
    least = keep(hood.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = hood.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    out = keep(moved.where("u > v").distinct(), "star")
    forget(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, which has none itself: then that one is its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of `edges` (u, v: integer ids), component being the least id reachable.

    Loops, repeated and reversed edges are allowed and change nothing; ids without an edge to another id
    are not returned; null ends are dropped. An empty table gives an empty table.
    """
    ends = edges.select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b")).where("a <> b")
    now = keep(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(now):
        stars = _star(now, large=True)
        forget(now)
        now = _star(stars, large=False)
        forget(stars)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
