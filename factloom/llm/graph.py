"""Connected components of an edge table, by least labels and pointer jumping; nothing but counts reaches the driver.

A node with very many edges, or a label that very many nodes have, is looked up by broadcast (see `common.looked_up`), so
no task holds all edges of a star or all members of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import hot_keys, looked_up, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): label is the least node of the component. Loops and repeated edges are harmless."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hot = hot_keys(both, "b")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = looked_up(both, labels.select(F.col("node").alias("b"), "label"), "b", hot=hot).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(looked_up(new, jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
