"""Connected components of an edge table, by rounds of contraction on Spark."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veracell.functions.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is its smallest node.

    Each round hangs every node below its smallest neighbour, shortens the paths, and contracts
    the edges to the roots, so edges shrink by at least half the non-root nodes a round.
    """
    e = cut_lineage(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("b").alias("v"), F.col("a").alias("u")).unionByName(
            e.select(F.col("a").alias("v"), F.col("b").alias("u")))
        up = cut_lineage(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("p")))
        for _ in range(2):
            above = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            up = up.join(above, "p").select("v", F.col("pp").alias("p"))
        up = cut_lineage(up)
        if labels is None:
            labels = up.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            labels = cut_lineage(labels.join(
                up.withColumnRenamed("v", "component"), "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")))
        a, b = (up.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        e = cut_lineage(e.join(a, "a").join(b, "b").where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return labels
