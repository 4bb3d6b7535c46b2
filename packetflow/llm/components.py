"""Connected components of a graph given as edges, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetflow.session import Scratch, cut_lineage


def star_edges(keyed: DataFrame, key: list[str], node: str = "node") -> DataFrame:
    """(a, b): each node of a key joined to the key's smallest node, so a key of n nodes gives n - 1 edges."""
    hubs = keyed.groupBy(*key).agg(F.min(node).alias("b"), F.max(node).alias("last")).filter("b <> last").drop("last")
    return keyed.join(hubs, key).select(F.col(node).alias("a"), "b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of an edge (a, b), a node of its component, the same for all of them.

    The graph is contracted until no edge is left. In a round each node is put into the first of itself and its neighbours:
    by id in the first round, which folds a star around its smallest node at once, later by a hash that changes with the
    round, which about halves any graph, a sorted chain included. Rounds therefore grow with the logarithm of the nodes, their
    size shrinks as fast, and the loop has no bound that could leave a component split. The steps are then read backwards.
    Null ends and loops are no edges.
    """
    both = edges.select("a", "b").filter("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    with Scratch(edges.sparkSession) as scratch:
        both, steps = scratch.keep(both), []
        while not both.isEmpty():
            n = len(steps)
            place = (lambda c: F.struct(c.alias("id"))) if n == 0 else (lambda c: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), c.alias("id")))  # noqa: B023
            first = both.groupBy("a").agg(F.min(place(F.col("b"))).alias("m"))
            steps.append(scratch.keep(first.select(F.col("a").alias("node"), F.least("m", place(F.col("a")))["id"].alias("into"))))
            ends = both.join(steps[-1].withColumnRenamed("node", "a"), "a").select(F.col("into").alias("a"), "b")
            ends = ends.join(steps[-1].withColumnRenamed("node", "b"), "b").select("a", F.col("into").alias("b"))
            both = scratch.keep(ends.filter("a <> b").distinct())
        if not steps:
            return cut_lineage(both.select(F.col("a").alias("node"), F.col("b").alias("component")))
        found = steps.pop().withColumnRenamed("into", "component")
        while steps:
            last = found.select(F.col("node").alias("into"), "component")
            found = scratch.keep(steps.pop().join(last, "into", "left").select("node", F.coalesce("component", "into").alias("component")))
        return cut_lineage(found)
