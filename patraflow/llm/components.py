"""Connected components by distributed minimum labels with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each node with an edge; label is the smallest node that it reaches. Empty edges give no rows."""
    both = save(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))), "edges")
    stored = save(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    labels = stored
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("to")).agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["to"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        step = save(step.join(up, step["label"] == up["at"], "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        moved = step.where("label < old").limit(1).count()
        drop(stored)
        stored, labels = step, step.select("node", "label")
        if not moved:
            drop(both)
            return labels
