"""Connected components of a graph of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import shared_table


def components(links: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, comp) for every node of `links` (a, b); comp is one node of its component.

    Each round hooks every node to its smallest smaller neighbour, follows such hooks `jumps`
    times over, and replaces the ends of all links by what they lead to; links within a node
    go. Every round that leaves links at least halves the nodes that have any. Hubs cost
    nothing special: neighbours are only ever reduced to a minimum.
    """
    both = links.union(links.select("b", "a")).toDF("a", "b").where("a != b").distinct()
    edges = shared_table(both, "edges")
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        hooks = edges.groupBy("a").agg(F.min("b").alias("to")).where("to < a")
        for _ in range(jumps):
            hooks = shared_table(hooks, "hooks")
            ahead = hooks.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
            hooks = hooks.join(ahead, "to", "left").select("a", F.coalesce("beyond", "to").alias("to"))
        hooks = shared_table(hooks, "hooks")
        ends = hooks.select(F.col("a").alias("comp"), "to")
        labels = shared_table(labels.join(ends, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            moved = hooks.select(F.col("a").alias(end), "to")
            edges = edges.join(moved, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = shared_table(edges.where("a != b").select("a", "b").distinct(), "edges")
    return labels
