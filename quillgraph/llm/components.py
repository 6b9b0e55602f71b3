"""Connected components by label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for the nodes of ``edges(a, b)``; the root is the smallest node of the component.

    A round gives every node the smallest root among its neighbours and then
    its root's root, so chains shrink geometrically. Each round is a table in
    the shared folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
    both = written(both.where("node <> other").distinct(), "component-edges")
    labels = written(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("root")), "component-labels")
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "r").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("r2"))
        new = lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("r2", "next")).alias("root"), (F.least("next", F.coalesce("r2", "next")) != F.col("root")).alias("moved"))
        new = written(new, "component-labels")
        labels = new.select("node", "root")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
