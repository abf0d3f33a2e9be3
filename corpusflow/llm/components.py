"""Connected components of an edge table, as joins and aggregates of bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives node, component: the least node reachable. Nodes without an edge are absent.

    Each round takes the least label of a node's neighbours, then the label of its label, so that long chains halve. Minima are
    aggregated before the shuffle; the one join by a node with very many neighbours is split by Spark's skew join.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        hop = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        step = scratch.table(lower.join(hop, F.col("component") == F.col("via"), "left").select("node", "old", F.least("component", F.coalesce("beyond", "component")).alias("component")))
        changed = step.filter("component <> old").limit(1).count()
        scratch.drop(labels)
        labels = step.select("node", "component")
        labels.scratch_path = step.scratch_path
        if not changed:
            scratch.drop(both)
            return labels
