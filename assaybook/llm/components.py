"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.llm.common import discard, look_up, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) from edges ``u, v``.

    Each round lowers every node's label to the least of its neighbours' and
    then to its label's label, so that chains halve; it ends when nothing
    changes. Labels are written each round. Hubs of many edges and labels of
    many nodes are few, and are broadcast. An empty table of edges gives no rows.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = stored(both, "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("node", F.least("node", "m").alias("component"), "degree")
    labels = stored(labels, "labels")
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("component").alias("c"), "degree")
        least = look_up(both, seen, ["v"], "degree").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        lowered = stored(labels.join(least, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"), "degree"), "labels")
        holders = lowered.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
        jump = stored(holders.join(labels.select(F.col("node").alias("component"), F.col("component").alias("further")), "component"), "labels")
        moved = look_up(lowered, jump, ["component"], "nodes").select("node", "was", F.least("component", "further").alias("component"), "degree")
        moved = stored(moved, "labels")
        discard(labels, lowered, jump)
        labels = moved
        if moved.filter("component <> was").isEmpty():
            discard(both)
            return labels.select("node", "component")
