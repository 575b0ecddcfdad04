"""Connected components of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.lineage import stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable; ``nodes`` (node), ``edges`` (i, j) in either direction.

    Each round a node takes the smallest label among its own and its neighbours', then the label of its label, so that
    rounds grow with the logarithm of a component's width. A round is one stored table.
    """
    both = stored(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    labels = stored(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        seen = both.join(labels, both["j"] == labels["node"]).groupBy("i").agg(F.min("root").alias("low"))
        new = labels.join(seen, labels["node"] == seen["i"], "left").select("node", "root", F.least("root", "low").alias("low"))
        up = new.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = stored(new.join(up, "low").select("node", "root", F.col("next").alias("low")))
        if new.where("root <> low").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", F.col("low").alias("root"))
