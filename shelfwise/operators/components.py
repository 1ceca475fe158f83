"""Connected components of a graph of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.sizing import materialise, sized


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of each component: ``(cell, label)``.

    Labels move along the edges and then jump to their own label's label, so the
    rounds grow with the logarithm of a chain's length. Each round is a reliable
    checkpoint. Labels of a counted few cells go to the edges, which then stay where they are.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialise(nodes.select("cell", F.col("cell").alias("label")))
    n = labels.count()
    while True:
        around = (
            both.join(sized(labels.select(F.col("cell").alias("b"), "label"), n), "b")
            .groupBy(F.col("a").alias("cell"))
            .agg(F.min("label").alias("near"))
        )
        moved = labels.join(around, "cell", "left").select(
            "cell", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        moved = materialise(moved)
        target = moved.select(F.col("cell").alias("label"), F.col("label").alias("further"))
        jumped = materialise(
            moved.join(target, "label").select("cell", "old", F.least("label", "further").alias("label"))
        )
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("cell", "label")
        if not changed:
            return labels
