"""Connected components of an edge table, by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every step is a partial
aggregation to the smallest neighbour and one equi-join, so a hub's edges can be split over
tasks by AQE; nothing is collected but one row of counts per round. Each round's edges are
written to the shared folder, so lineage never grows with the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = (both.join(least, "u").where("v > u")
             .select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a > b").distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    return (joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a > b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node it reaches.

    Null ends, loops, repeated and reversed edges are ignored. No edges: no rows. Any orderable
    node type works.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(edges.distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        edges = staged(_stars(edges), "edges")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    # The fixed point is a set of stars: every node but the root points at the root.
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(edges.select("b", F.col("b").alias("root")).distinct()))
