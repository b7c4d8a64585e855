"""Connected components of edges in a DataFrame, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b): (node, label), label being the smallest node of the component.

    Each round hooks every label to the smallest label next to it, follows the hooks
    twice and contracts the edges, so paths shrink by a factor a round. A hub's edges
    meet in map-side minima, and in joins whose other side has unique keys, which
    adaptive execution can split.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = scratch(nodes.withColumn("label", F.col("node")), "labels")
    live = scratch(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while live.limit(1).count():
        both = live.union(live.select("b", "a"))
        hooks = near = scratch(both.groupBy(F.col("a").alias("label")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(onward, "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        first, before = near, (labels, live)
        hooks = scratch(hooks, "hooks")
        labels = scratch(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a = hooks.select(F.col("label").alias("a"), F.col("to").alias("ta"))
        b = hooks.select(F.col("label").alias("b"), F.col("to").alias("tb"))
        moved = live.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        live = scratch(moved.distinct(), "edges")
        discard(first, hooks, *before)
    return labels
