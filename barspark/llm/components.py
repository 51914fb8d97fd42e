"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.storage import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for each node of an edge the smallest node that it reaches.

    Every round takes the smallest label among a node's neighbours and then the label of that label, until nothing changes.
    Labels are aggregated before they are shuffled, and each round is stored in the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("m"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.least("root", "m").alias("to"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("to"), F.col("root").alias("above"))
        moved = stored(hooked.join(up, "to").select("node", F.least("to", "above").alias("root"), "was"), "labels")
        if moved.filter("root <> was").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")
