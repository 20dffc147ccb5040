"""Connected components of large, sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for ``edges`` (a, b): nodes of one component share the
    smallest node as label. Labels travel along edges and then jump to the
    label's own label, so that a path of n nodes takes about log n rounds. Each
    round is written to the shared folder."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = shared.stage(both, "edges")
    labels = shared.stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        closer = labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # A label is a node too: follow it one step.
        roots = labels.select(F.col("node").alias("r"), F.col("label").alias("root"))
        jumped = closer.join(roots, F.col("label") == F.col("r"), "left").select("node", "old", F.least("label", "root").alias("label"))
        before, labels = labels, shared.stage(jumped, "labels")
        shared.release(before)
        if labels.filter("old <> label").isEmpty():
            shared.release(both)
            return labels.select("node", "label")
    raise RuntimeError("components did not settle")
