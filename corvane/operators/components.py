"""Connected components by hooking and pointer jumping, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.store import drop, stored


def _jumped(parent: DataFrame) -> DataFrame:
    """Follow parents until each node points at a root; the depth at least halves in each round."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        deeper = stored(parent.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"), (F.col("top") < F.col("parent")).alias("moved")), "jump")
        moved = not deeper.filter("moved").isEmpty()
        drop(parent)
        parent = deeper.select("node", "parent")
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs to (node, root): root is the smallest node that can be reached.

    Nodes without a link to another node have no row. Null ends, loops and repeated
    links count for nothing; an empty table gives an empty table. Each round hooks every
    node to its smallest neighbour and contracts the trees, so that the nodes left at
    least halve.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "links")
    label = None
    while label is None or not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("node", "other")
        parent = _jumped(stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), "hook"))
        up = parent.select(F.col("node").alias("root"), F.col("parent").alias("top"))
        if label is None:
            label = parent.select("node", F.col("parent").alias("root"))
        else:
            label = stored(label.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "label")
        a, b = (parent.select(F.col("node").alias(x), F.col("parent").alias(f"{x}_top")) for x in "ab")
        left = stored(links.join(a, "a").join(b, "b").select(F.greatest("a_top", "b_top").alias("a"), F.least("a_top", "b_top").alias("b")).filter("a <> b").distinct(), "links")
        drop(links)
        links = left
    return label
