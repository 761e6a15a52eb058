"""Connected components of a large graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buslens.scale import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (``a, b``); the root is the smallest node.

    Every node keeps the link to the smallest of its smaller neighbours, and its
    other links move up to that one, until each node has one link up. No
    neighbour list is gathered. Then pointers are halved until each names a root.
    Every round is written to the shared folder, so lineage stays short.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        edges = materialise(edges, "links")
        least = edges.groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("n"))
        raised = materialise(edges.join(least, "u"), "raised")
        if raised.where("n > 1").isEmpty():
            break
        moved = raised.where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        edges = raised.where("v = p").select("u", "v").union(moved).distinct()
    up = raised.select("u", "p")
    while True:
        above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = up.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
        jumped = materialise(jumped, "parents")
        up = jumped.select("u", "p")
        if jumped.where("moved").isEmpty():
            break
    roots = up.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct()
    return up.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(roots)
