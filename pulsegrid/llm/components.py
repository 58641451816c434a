"""Connected components of links, by minimum labels and pointer jumping. Links stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import join_facts
from pulsegrid.session import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of a link; component is the smallest node reachable."""
    edges = durable(
        links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .where(F.col("x") != F.col("y")).distinct()
    )
    ends = durable(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"), F.count(F.lit(1)).alias("often")))
    labels, many, nodes = ends.select("x", "label"), edges.count(), ends.count()
    while True:
        # The smallest label next door, then the label of that label: paths halve each round. A node with many links, and a
        # label of many nodes, are joined where these are.
        known = labels.join(ends.select("x", "often"), "x").select(F.col("x").alias("y"), "label", "often")
        near = join_facts(edges, known, "y", many).groupBy("x").agg(F.min("label").alias("near"))
        lower = durable(labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        shared = lower.groupBy("label").agg(F.count(F.lit(1)).alias("often"))
        following = lower.select(F.col("x").alias("label"), F.col("label").alias("next")).join(shared, "label")
        step = durable(join_facts(lower, following, "label", nodes).select("x", "old", F.least("label", "next").alias("label")))
        labels = step.select("x", "label")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
