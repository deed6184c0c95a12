"""Connected components by rounds of hooking and contraction; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges a, b (long). Null ends are ignored.

    Each round every node hooks to its smallest neighbour, chains are shortened twice, and edges are drawn anew
    between what is left. A star or clique goes in one round, a chain in logarithmically many.
    """
    scratch = Scratch()
    staged = scratch.staged
    left = staged(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().distinct(), "cc-edges")
    labels = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        parent = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up"))
        parent = staged(parent, "cc-parent")
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
        parent = staged(parent, "cc-parent")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            moved = parent.select(F.col("node").alias("component"), "up")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = staged(labels, "cc-labels")
        to_a, to_b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"{x}2")) for x in ("a", "b"))
        new = left.join(to_a, "a").join(to_b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        left = staged(new.filter("a <> b").distinct(), "cc-edges")
        scratch.clear(left, labels)
        if left.isEmpty():
            scratch.clear(labels)
            return labels
