"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.sources.tables import stored_layer


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``edges`` (a, b).

    Each round takes the smallest label around a node and then follows labels to their own labels, so paths halve:
    rounds grow with the logarithm of the longest path.  Every round is stored, which keeps plans short and survives
    lost executors.  Rows travel by node: fine for graphs of bounded degree, such as neighbouring grid cells.
    """
    both = stored_layer(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    labels = stored_layer(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "graph-labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        lower = labels.join(around, "node").select("node", "label", F.least("label", "least").alias("next"))
        onward = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        moved = stored_layer(lower.join(onward, "next").select("node", "label", F.least("next", "further").alias("next")), "graph-labels")
        if moved.where("next < label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", F.col("next").alias("label"))
