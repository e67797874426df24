"""Centrality of entities: rank by confidence, and share of shortest paths.

Both are rounds over frontier tables, each written in the shared folder. Ties of an entity with
many are split into shares (``paths.Ties``), and what flows to an entity is summed
in each task before it is shuffled, so hubs make no large task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .findings import Graph
from .paths import SHARE, Ties

DAMPING = 0.85


def weighted(g: Graph) -> DataFrame:
    """(a, b, weight): the confidences of all ties of a pair, added up, in either direction."""
    ends = F.explode(F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b"))))
    both = g.statements.where("subject_id != object_id").select(ends.alias("e"), "confidence")
    return both.groupBy("e.a", "e.b").agg(F.sum("confidence").alias("weight")).where("weight > 0")


def pagerank(entities: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = 1e-8, rounds: int = 200, share: int = SHARE) -> DataFrame:
    """(entity_id, rank) of all ``entities`` by power iteration; ranks add up to 1.

    edges: (a, b, weight). From an entity rank flows along its ties by weight; that of entities
    without ties flows to all alike. It ends when a round changes ranks by ``tolerance`` in all, or
    after ``rounds``. Three sums a round reach the driver. Ties of entities that aren't in the table don't count.
    """
    known = checkpointed(entities.select("entity_id").where("entity_id is not null").distinct())
    n = known.count()
    if not n:
        return known.select("entity_id", F.lit(None).cast("double").alias("rank"))
    ends = edges.join(known.withColumnRenamed("entity_id", "a"), "a", "left_semi").join(known.withColumnRenamed("entity_id", "b"), "b", "left_semi")
    ends = checkpointed(ends.select("a", "b", "weight"))
    total = ends.groupBy("a").agg(F.sum("weight").alias("total"))
    ties = Ties(ends.join(total, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("part")), share)
    # total is null for entities without ties
    out = known.join(total.withColumnRenamed("a", "entity_id"), "entity_id", "left").select("entity_id", F.col("total").isNull().alias("dangling"))
    ranks = checkpointed(out.withColumn("rank", F.lit(1.0 / n)))
    for _ in range(rounds):
        loose = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = ties.meet(ranks.where("not dangling").select("entity_id", "rank"), "entity_id")
        flow = flow.groupBy(F.col("b").alias("entity_id")).agg(F.sum(F.col("rank") * F.col("part")).alias("flow"))
        new = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + loose / n)
        both = checkpointed(ranks.join(flow, "entity_id", "left").select("entity_id", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        ranks = both.drop("change")
        if tolerance and both.agg(F.sum("change")).first()[0] <= tolerance:
            break
    return ranks.select("entity_id", "rank")


def pivots(entities: DataFrame, n: int | None) -> DataFrame:
    """(source): ``n`` entities by the order of their ids' hashes, which doesn't depend on the graph; all for none."""
    own = entities.select(F.col("entity_id").alias("source"))
    return own if n is None else own.orderBy(F.md5("source"), "source").limit(n)


def betweenness(edges: DataFrame, sources: DataFrame, scale: float = 1.0, share: int = SHARE, hops: int | None = None) -> DataFrame:
    """(entity_id, betweenness): how many shortest paths from ``sources`` run through each entity, as shares, times ``scale``.

    edges: (a, b) in both directions. sources: (source). From every source at one time, a
    frontier counts the shortest paths to each entity, step by step; then, from the last step back, each
    entity hands on its share to those before it in proportion to their counts. With all
    entities as sources and a scale of 1/2 it is the exact betweenness of an undirected graph; with
    n of N sources, a scale of N / (2 n) estimates it. ``hops`` bounds paths where only near ones count.
    """
    ties = Ties(edges.select("a", "b").where("a != b").distinct(), share)
    levels = [checkpointed(sources.select("source", F.col("source").alias("at"), F.lit(1.0).alias("paths")).distinct())]
    seen = levels[0].select("source", "at")
    while hops is None or len(levels) <= hops:
        moved = ties.meet(levels[-1], "at").groupBy("source", F.col("b").alias("at")).agg(F.sum("paths").alias("paths"))
        new = checkpointed(moved.join(seen, ["source", "at"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        # An entity's neighbours are at most one step nearer or farther, so two levels back are enough.
        seen = levels[-1].select("source", "at").unionByName(levels[-2].select("source", "at"))
    shares = [s.where("at != source") for s in _handed_back(ties, levels)]
    if not shares:
        return levels[0].select(F.col("at").alias("entity_id"), F.lit(0.0).alias("betweenness")).limit(0)
    every = shares[0]
    for s in shares[1:]:
        every = every.unionByName(s)
    return every.groupBy(F.col("at").alias("entity_id")).agg((F.sum("handed") * scale).alias("betweenness")).where("betweenness > 0")


def _handed_back(ties: Ties, levels: list[DataFrame]) -> Iterator[DataFrame]:
    """(source, at, handed) of each level but the last, from the end: the shares of paths that go on through an entity."""
    later = levels[-1].withColumn("handed", F.lit(0.0))
    for level in reversed(levels[:-1]):
        before = level.select("source", F.col("at").alias("b"), F.col("paths").alias("own"))
        back = ties.meet(later, "at").join(before, ["source", "b"])
        handed = back.groupBy("source", F.col("b").alias("at")).agg(F.sum(F.col("own") / F.col("paths") * (1 + F.col("handed"))).alias("handed"))
        later = checkpointed(level.join(handed, ["source", "at"], "left").select("source", "at", "paths", F.coalesce("handed", F.lit(0.0)).alias("handed")))
        yield later.select("source", "at", "handed")
