"""Connected components of links by label propagation with pointer jumping, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds after which something must be wrong: labels reach over twice as far in every round.
MOST_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected links (a, b); the label is the component's smallest node.

    Labels are written to the shared folder after every round, those of the round before go; nothing but a count comes to
    the driver.
    """
    with common.scratch() as keep:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        both = common.materialize(both.distinct(), "components-links")
        labels = common.materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "components-labels")
        for _ in range(MOST_ROUNDS):
            others = labels.select(F.col("node").alias("other"), F.col("label").alias("other_label"))
            seen = both.join(others, "other").groupBy("node").agg(F.min("other_label").alias("seen"))
            nearer = labels.join(seen, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("before"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            nearer = nearer.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "before")
            labels = common.materialize(nearer, "components-labels")
            if not labels.where("label <> before").limit(1).count():
                return keep(labels).select("node", "label")
        raise RuntimeError("labels did not settle")


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels (node, label) after more links (a, b): only the components that those join are gone through."""
    if labels is None:
        return connected(links)
    la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    ends = links.join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    joined = connected(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("lower"))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    fresh = nodes.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return labels.unionByName(fresh).join(joined, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
