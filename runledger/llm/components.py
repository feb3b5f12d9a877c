"""Connected components of a graph of links, as a loop of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import kept_table


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over ``links`` (a, b), for nodes that have any.

    Every round each node takes the smallest label around it, and then that
    label's own label. Each round is a written table; nothing but the number of
    changed labels reaches the driver.
    """
    both = kept_table(
        links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct().toDF("node", "near"), "links"
    )
    labels = both.groupBy("node").agg(F.least("node", F.min("near")).alias("label"))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("seen")), "near")
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        following = kept_table(
            nearer.join(above, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "labels"
        )
        if following.where("label != old").isEmpty():
            return following.select("node", "label")
        labels = following.select("node", "label")
