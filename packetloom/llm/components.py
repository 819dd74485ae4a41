"""Connected components of an edge list by hooking to the smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node.

    Every round takes the smallest label among the neighbours (a map-side combined aggregate, so a
    node with very many links is no hot spot) and then the label's own label. Each round is written
    to the shared folder, which cuts the lineage and survives lost executors.
    """
    one_way = edges.where("a <> b").select("a", "b")
    both = materialise(one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hooked = materialise(hooked, f"{name}-hooked")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = materialise(hooked.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("root", "label")).alias("label"), (F.col("old") > F.least("label", F.coalesce("root", "label"))).alias("moved")), f"{name}-labels")
        moved = labels.where("moved").limit(1).count()
        labels = labels.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
