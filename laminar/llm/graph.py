"""Connected groups of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest node it reaches.

    Every round points each node at its smallest neighbour, follows that pointer twice and contracts the links, so
    rounds grow with the logarithm of the longest chain.  Links stay a distributed table; only a count of what is left
    reaches the driver.  Null ends and loops are ignored.
    """
    edges = stored(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    groups = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("p"))
        point = near.select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        point = stored(point, "pointers")
        for _ in range(2):
            up = point.select(F.col("node").alias("p"), F.col("p").alias("q"))
            point = point.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        point = stored(point, "pointers")
        if groups is None:
            groups = point.withColumnRenamed("p", "root")
        else:
            hop = point.select(F.col("node").alias("root"), F.col("p").alias("q"))
            groups = stored(
                groups.join(hop, "root", "left").select("node", F.coalesce("q", "root").alias("root")), "groups"
            )
        ends = [point.select(F.col("node").alias(c), F.col("p").alias(f"_{c}")) for c in "ab"]
        shrunk = (
            edges.join(ends[0], "a")
            .join(ends[1], "b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = stored(shrunk, "links")
    if groups is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return groups
