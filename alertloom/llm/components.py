"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom.session import stage


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each linked node reaches over links `a, b`.

    Each round every node takes the smallest component among its neighbours, then the component
    of its component, so that chains shorten by half. Rounds are written, and joins read written
    tables, so hot nodes can be split and a lost executor costs a re-read.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(
        F.least("a", F.min("b")).alias("component")), "components")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lower = stage(
            labels.join(near, "node").select(
                "node", F.col("component").alias("was"), F.least("component", "near").alias("component")),
            "components-near")
        top = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = stage(
            lower.join(top, "component").select("node", "was", F.least("component", "top").alias("component")),
            "components")
        labels = jumped.select("node", "component")
        if jumped.filter("component <> was").isEmpty():
            return labels
