"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of an edge (a, b) is joined to.

    Every round takes the least label among the neighbours and then the label of the label,
    so chains halve. Labels are written each round: nothing is held on the driver, and a
    lost executor costs only its tasks. Ends when a round changes nothing.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both.filter("a <> b").distinct(), "links")
    labels = links.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        near = (links.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = written(lower.join(jump, "label").select(
            "node", F.least("label", "jump").alias("label"),
            (F.least("label", "jump") != F.col("old")).alias("moved")), "labels")
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
