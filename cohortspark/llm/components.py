"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.session import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as ``m``.

    The least is kept as a table of its own, so that the join reads two plain exchanges and a
    node with very many neighbours can be split over tasks.
    """
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); the root is the least node of its component.

    A large star hangs every greater neighbour of a node onto the least one, a small star every
    smaller one; both keep the components, and the number of rounds grows with the logarithm of
    the longest chain.  Each round is kept on shared storage, and only sums reach the driver.
    Links of a node with itself count for nothing; an empty table gives an empty one.
    """
    edges = materialise(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = materialise(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        starred = _with_least(hung)
        pairs = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
        edges = materialise(starred.select(pairs.alias("p")).select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u > v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return members.unionByName(roots).distinct()
