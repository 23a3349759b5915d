"""Connected components of an edge table by hooking, pointer jumping and contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

MAX_ROUNDS = 60


def _roots(pairs: DataFrame) -> DataFrame:
    """node, label of every node of pairs (a >= b): each hooks to its least neighbour, and hooks are followed to their ends."""
    ends = pairs.select(F.col("a").alias("node"), "b").union(pairs.select(F.col("b").alias("node"), "b"))
    labels = materialize(ends.groupBy("node").agg(F.min("b").alias("label")), "hooks")
    for _ in range(MAX_ROUNDS):
        # a label is a node, too; its own label is at most as great
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step = materialize(labels.join(jump, F.col("label") == F.col("_n")).select("node", F.col("label").alias("old"), F.col("_l").alias("label")), "hooks")
        discard(labels)
        if step.where("label < old").isEmpty():
            return step
        labels = step
    raise RuntimeError(f"hooks did not settle in {MAX_ROUNDS} rounds")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node of edges (a, b), both long; edges with a null are left out.

    Each round puts roots in the place of nodes and keeps only edges between different roots, so edges within what is
    joined already are read once, however large the component.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    pairs = materialize(edges.where("a is not null and b is not null").select(high, low).distinct(), "edges")
    labels = None
    for _ in range(MAX_ROUNDS):
        roots = _roots(pairs)
        moved = roots.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        if labels is None:
            labels = roots.select("node", "label")
        else:
            labels = materialize(labels.join(moved, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label")), "labels")
        # an edge to the root itself is within one component: it goes before the join on the hot side
        ends = pairs.join(moved, F.col("a") == F.col("_n")).where("_l <> b").select(F.col("_l").alias("a"), "b")
        ends = ends.join(moved, F.col("b") == F.col("_n")).where("a <> _l").select("a", F.col("_l").alias("b"))
        fewer = materialize(ends.select(high, low).distinct(), "edges")
        discard(pairs)
        if fewer.isEmpty():
            return labels
        pairs = fewer
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
