"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of ``edges(a, b)``: the smallest node it reaches.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so a chain of length n needs about log n rounds.
    Every round is a written table; only a count of changes reaches the driver.
    Self links and repeated links are allowed; an empty edge table gives an
    empty result.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(),
        "edges",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        labels = materialize(low.join(up, "low", "left").select("node", "old", F.least("low", F.coalesce("up", "low")).alias("label")), "labels")
        if labels.where("label != old").limit(1).count() == 0:
            return labels.select("node", "label")
        labels = labels.select("node", "label")
