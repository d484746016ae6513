"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` has long columns a, b. Returns node, label: the least node of its component.

    Each round takes the least label among a node and its neighbours, then the label of that
    label, so that chains shrink by halves. Every round is a written table.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = before = materialise(labels.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).select("a", "label")
        least = near.groupBy("a").agg(F.min("label").alias("near"))
        joined = labels.join(least, labels.node == least.a, "left").select(
            "node", "label", F.least("label", "near").alias("lower")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = joined.join(jump, joined.lower == jump["at"], "left").select(
            "node", F.least("lower", "further").alias("new"), "label"
        )
        moved = materialise(moved, "labels")
        release(before)
        before = moved
        done = moved.filter(F.col("new") < F.col("label")).isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if done:
            release(both)
            return labels
