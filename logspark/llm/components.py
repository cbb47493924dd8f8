"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); a component is
    named by its smallest node.

    Each round gives a node the smallest label among its neighbours and then
    the label of its label, so long chains shrink fast.  The labels are
    written after each round, which cuts the lineage; hot nodes only meet
    partial minima and joins that Spark can split.
    """
    both = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                         .where("a <> b").distinct(), f"{name}-links")
    labels = scratch.write(both.groupBy("a").agg(F.min("b").alias("m"))
                           .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy("a").agg(F.min("component").alias("seen")))
        lower = (labels.join(near, labels["node"] == near["a"])
                 .select("node", F.col("component").alias("old"), F.least("component", "seen").alias("via")))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("next"))
        labels = scratch.write(lower.join(jump, "via", "left").select(
            "node", F.least("via", "next").alias("component"), (F.least("via", "next") != F.col("old")).alias("moved")),
            f"{name}-{turn}")
        moved = labels.where("moved").limit(1).count()
        labels = labels.drop("moved")
        scratch.drop(f"{name}-{turn - 1}")
        if not moved:
            scratch.drop(f"{name}-links")
            return labels
