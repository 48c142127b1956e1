"""Connected components by joins: every node takes the smallest label next to it, then jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): the smallest node that links reach, for each node of an edge.

    A round is a map-side combined minimum over neighbours and two jumps along the labels, so the
    number of rounds grows with the logarithm of the longest chain. Each round is written to the
    shared folder. No group is collected: hubs are aggregated, hot labels are join keys.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    labels = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a").agg(F.min("root").alias("near"))
            .withColumnRenamed("a", "node")
        )
        # The old root also learns of the better one: else a hub would keep its label for long.
        met = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        hooked = met.where("root < was").groupBy(F.col("was").alias("node")).agg(F.min("root").alias("better"))
        met = met.join(hooked, "node", "left").select(
            "node", "was", F.least("root", F.coalesce("better", "root")).alias("root")
        )
        met = cut_lineage(met)
        jump = met.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = cut_lineage(
            met.join(jump, "root", "left")
            .select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root"))
        )
        if labels.where("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
