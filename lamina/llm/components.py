"""Connected components of links between ids, by passing on the smallest id with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import looked_up, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has a link.

    Each round takes the smallest label around, then the label of that label, so rounds grow with the logarithm of a
    chain's length. Labels are written to the shared folder. A hub's links and a large component's nodes are hot keys,
    whose labels are broadcast (see looked_up).
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = written(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    total = edges.count()
    labels = written(edges.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("component"), "n"))
    nodes = labels.count()
    while True:
        around = looked_up(edges, labels.withColumnRenamed("node", "other"), "other", total).select("node", "component")
        least = around.groupBy("node").agg(F.min("component").alias("around"))
        nearest = written(labels.join(least, "node").select("node", "n", F.col("component").alias("before"), F.least("component", "around").alias("component")))
        named = nearest.groupBy("component").agg(F.count("*").alias("n"))
        jump = named.join(labels.select(F.col("node").alias("component"), F.col("component").alias("next")), "component")
        moved = looked_up(nearest, jump, "component", nodes)
        labels = written(moved.select("node", "before", F.least("component", "next").alias("component"), "n"))
        changed = labels.where("component <> before").limit(1).count()
        labels = labels.drop("before")
        if not changed:
            return labels.drop("n")
