"""Connected components over edge tables, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge with two ends.

    Each round a node takes the smallest label among its neighbours, the node that gave a label
    takes the smallest its followers found, and labels jump to their own label; rounds follow the
    logarithm of the longest path, not its length, in practice. Every table is written to the
    shared folder between rounds. Edges may repeat, point either way or be loops; null ends are
    ignored. No edges: no rows.
    """
    one = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = materialize(one.union(one.select("y", "x")).distinct(), "cc-edges")
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "cc-labels")
    changed = labels.limit(1).count()
    while changed:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("theirs")), "y").groupBy(F.col("x").alias("node")).agg(F.min("theirs").alias("theirs"))
        met = materialize(labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "theirs").alias("label")), "cc-met")
        hubs = met.groupBy(F.col("was").alias("node")).agg(F.min("label").alias("found"))
        met2 = materialize(met.join(hubs, "node", "left").select("node", "was", F.least("label", "found").alias("label")), "cc-hub")
        jump = met2.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(met2.join(jump, "label", "left").select("node", "was", F.least("label", "next").alias("label")), "cc-labels")
        changed = new.filter("label <> was").limit(1).count()
        drop_scratch(labels, met, met2)
        labels = new.select("node", "label")
    return labels.select("node", F.col("label").alias("component"))
