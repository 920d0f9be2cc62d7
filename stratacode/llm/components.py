"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacode.llm.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of ``edges`` (a, b) with the smallest node it can reach.

    Labels spread along edges and then jump to the label of their label, so chains shrink geometrically.  Each round
    stages the labels; only the number of changed labels reaches the driver.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        target = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = stage(
            spread.join(target, "next").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") != F.col("label")).alias("moved")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
