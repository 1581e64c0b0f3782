"""Connected components of an edge table by label propagation with pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, sized, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label): every node of (a, b) with the smallest id of its component.

    A round takes the least label among a node and its neighbours, then follows labels twice; every round is
    written to the shared folder, so a lost executor repeats one round at most. Stars take two rounds.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    rows = 2 * edges.count()
    both = stored(sized(both, rows), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id")
    labels = stored(sized(labels, rows), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        for _ in range(2):
            onward = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
            step = step.join(onward, "label").select("id", "old", F.least("label", "next").alias("label"))
        step, last = stored(sized(step, rows), "labels"), labels
        moved = step.where("label < old").limit(1).count()
        labels = step.select("id", "label")
        dropped(last)
        if not moved:
            dropped(both)
            return labels
