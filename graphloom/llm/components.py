"""Connected components of an edge frame, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, release


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of edges (a, b): the label is the least node of its component.

    Edges that are null on a side are the caller's to leave out; a loop joins nothing; no edges give no rows; repeated edges count once.
    Least labels travel along the edges, then every label is replaced by its own label, until nothing changes; rounds grow with the
    logarithm of a component's width. Sums by node are combined before the shuffle, so hubs are no hot spot.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}_edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}_labels")
    held = labels
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        lower = cut(lower, f"{name}_lower")
        own = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(own, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label"))
        done = cut(jumped, f"{name}_round")
        release(lower, held)
        held, labels = done, done.select("node", "label")
        if not done.where("label <> was").limit(1).count():
            release(both)
            return labels
