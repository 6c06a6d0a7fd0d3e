"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node with an edge to another the smallest node it can reach.

    Alternates the large-star and small-star steps of Kiveris et al., which hang neighbours
    below their smallest neighbour, until the edges are stars; O(log^2) rounds.  A step is a
    min-aggregation and a join that Spark can split where a node has very many edges.  Every round
    is written to the shared folder and replaces the one before.
    """
    scratch = Scratch(edges.sparkSession, "components")
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    e = scratch.save(edges.select(lo, hi).filter("lo < hi").distinct())
    while not _stars(e):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        new = scratch.save(small.union(least.select(F.col("m").alias("lo"), "hi")).distinct())
        scratch.drop(e)
        e = new
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def _stars(e: DataFrame) -> bool:
    """Whether every node is a root or hangs below one root only."""
    ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        e.select(F.col("lo").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    each = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.filter("below > 1 or (below = 1 and above = 1)").isEmpty()
