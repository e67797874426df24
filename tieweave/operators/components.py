"""Connected components of an edge table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written

#: Hooks are followed 2 ** JUMPS steps within a round.
JUMPS = 3


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node reachable.

    In each round every node hooks to its least neighbour, chains of hooks are
    shortened, and the edges are contracted to what still joins different labels. The
    edges left shrink by a constant factor or more, so rounds grow with the logarithm of
    the longest path. Both tables are written in each round; nothing but "is any
    edge left" reaches the driver, as the joins are told to shuffle. They are no checkpoints:
    these keep the optimizer's estimate of a table's size, which a join of hooks with themselves
    squares: the number has 17 times as many bits after each round.
    """
    left = written(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    )
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
        # Each jump is written, as jumps within one plan would be 2 ** JUMPS copies of it, with all their joins at one time.
        for _ in range(JUMPS):
            hooks = written(_follow(hooks, hooks))
        labels = written(hooks if labels is None else _follow(labels, hooks))
        ends = hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        others = hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        left = written(
            left.join(ends.hint("merge"), "a")
            .join(others.hint("merge"), "b")
            .where("root_a != root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
            .distinct()
        )
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.hint("merge")  # files tell little of their size in memory


def _follow(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """``labels`` with each root replaced by what ``hooks`` has for it, if anything."""
    step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(step.hint("merge"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
