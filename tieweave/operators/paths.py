"""Connections of two entities: the best paths between them, and what the paths say together.

A step from one entity to another is the best tie between them, by confidence times the
conductance of its type. A path's score is the product over its steps, damped for each step
after the first. Paths visit no entity twice and don't run through hubs.

``best_paths`` works on frontier tables, for all wanted pairs at one time. Backwards from the
goals, ``_bounds`` finds the best score that any walk of so many steps can still add; of all walks
from an entity to a goal only the best is kept, the others being dominated by it. Forwards,
a path goes on only while its score times that bound reaches the pair's k-th best path so
far. As a bound is never below what a path can add, no path that belongs in the result is lost.

Ties of an entity are split by hash into shares of at most SHARE ties on average, and the
frontier's rows for it are sent to each share, so an entity with a third of all ties is met by many tasks. They lie
in buckets, so a step shuffles the frontier alone.

The frontier carries entities and scores; statements, their confidence and sources are looked up
for the paths that are found. The last step goes to the goal alone.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..checkpoints import bucketed, checkpointed, written
from ..schemas import HUB_TYPES
from .findings import Graph

DAMPING = 0.85
SHARE = 10_000
#: Scores closer than this are one score; ties go by the path.
DIGITS = 9


def steps(g: Graph) -> DataFrame:
    """(a, b, factor, confidence, statement_id, sources, passable): the best tie of each pair in either direction; ``passable`` says that b is no hub."""
    types = F.broadcast(schemas.statement_types(g.statements.sparkSession).select("statement_type", "conductance"))  # a fixed lookup table
    own = g.statements.where("subject_id != object_id").join(types, "statement_type")
    tie = F.struct((F.col("confidence") * F.col("conductance")).alias("factor"), "confidence", "statement_id", "sources")
    ends = F.explode(F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b"))))
    both = own.select(ends.alias("e"), tie.alias("tie")).select("e.a", "e.b", "tie")
    best = both.groupBy("a", "b").agg(F.min_by("tie", F.struct((-F.col("tie.factor")).alias("less"), F.col("tie.statement_id"))).alias("tie"))
    hubs = g.hubs.select(F.col("entity_id").alias("b"), F.lit(True).alias("hub"))
    return best.join(hubs, "b", "left").select("a", "b", "tie.*", F.col("hub").isNull().alias("passable"))


def _factors(g: Graph) -> DataFrame:
    """(a, b, factor, passable) of ``steps``."""
    types = F.broadcast(schemas.statement_types(g.statements.sparkSession).select("statement_type", "conductance"))  # a fixed lookup table
    own = g.statements.where("subject_id != object_id").join(types, "statement_type")
    factor = F.max(F.col("confidence") * F.col("conductance")).alias("factor")
    best = own.groupBy(F.least("subject_id", "object_id").alias("x"), F.greatest("subject_id", "object_id").alias("y")).agg(factor)
    ends = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    hubs = g.hubs.select(F.col("entity_id").alias("b"), F.lit(True).alias("hub"))
    return best.select(ends.alias("e"), "factor").select("e.a", "e.b", "factor").join(hubs, "b", "left").select("a", "b", "factor", F.col("hub").isNull().alias("passable"))


class Ties:
    """Steps split into shares, for joins with frontiers. Written once.

    With ``buckets`` a step shuffles the frontier alone, and no side is collected for a broadcast: files tell little of their
    size in memory.
    """

    def __init__(self, edges: DataFrame, share: int = SHARE, buckets: bool = False) -> None:
        self.buckets = buckets
        edges = written(edges)
        counts = edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > share)
        # One row for ``share`` ties at most.
        self.large = F.broadcast(checkpointed(counts.select("a", F.ceil(F.col("n") / share).cast("int").alias("shares"))))
        dealt = edges.join(self.large, "a", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")), F.lit(0)).cast("int")
        dealt = dealt.withColumn("salt", salt).drop("shares")
        self.edges = bucketed(dealt, "a", "salt") if buckets else checkpointed(dealt)

    def meet(self, rows: DataFrame, at: str) -> DataFrame:
        """``rows`` with each tie of the entity in their column ``at``."""
        where = rows.join(self.large.withColumnRenamed("a", at), at, "left")
        sent = where.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares") - 1, F.lit(0))))).drop("shares")
        return (sent.hint("merge") if self.buckets else sent).join(self.edges.withColumnRenamed("a", at), [at, "salt"]).drop("salt")


def _bounds(ties: Ties, goals: DataFrame, hops: int, damping: float) -> list[DataFrame]:
    """For each number of steps left, (goal_id, at, best): the most that a walk of so many steps or fewer from ``at`` to the goal multiplies a score by."""
    first = checkpointed(goals.select("goal_id", F.col("goal_id").alias("at"), F.lit(1.0).alias("best")))
    found, front = [first], first
    for _ in range(hops - 1):
        # Ties lead both ways, so a walk towards the goal is one from it; only passable entities or the goal itself are left again.
        moved = ties.meet(front, "at").where("passable").select("goal_id", F.col("b").alias("at"), (F.col("best") * F.col("factor") * damping).alias("best"))
        better = moved.groupBy("goal_id", "at").agg(F.max("best").alias("best"))
        known = found[-1].withColumnRenamed("best", "old")
        front = written(better.hint("merge").join(known, ["goal_id", "at"], "left").where("old is null or best > old").select("goal_id", "at", "best"))
        found.append(written(found[-1].unionByName(front).groupBy("goal_id", "at").agg(F.max("best").alias("best"))))
    return found


def _in_order() -> list[Column]:
    return [F.desc(F.round("score", DIGITS)), F.col("path")]


def _best(found: DataFrame, keep: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("start_id", "goal_id").orderBy(*_in_order()))
    return found.withColumn("place", place).where(F.col("place") <= keep)


def best_paths(g: Graph, pairs: DataFrame, hops: int = 4, keep: int = 3, damping: float = DAMPING, share: int = SHARE) -> DataFrame:
    """(start_id, goal_id, place, path, statement_ids, score, confidence, sources): the ``keep`` best paths of ``hops`` steps at most.

    pairs: (start_id, goal_id); rows that repeat count once, those with one entity on both sides or null have no path.
    confidence is the product over the path, where steps that rest on the same sources
    count once, with the least of them, as they err together. sources are those of all steps, sorted.
    """
    wanted = checkpointed(pairs.select("start_id", "goal_id").where("start_id != goal_id").distinct())
    goals = wanted.select("goal_id").distinct()
    # Hubs that are no goal lead nowhere.
    aims = goals.withColumnRenamed("goal_id", "b").withColumn("aim", F.lit(True))
    ties = Ties(_factors(g).join(aims, "b", "left").where("passable or aim").drop("aim"), share, buckets=True)
    bounds = _bounds(ties, goals, hops, damping)
    front = wanted.select("start_id", "goal_id", F.col("start_id").alias("at"), F.array("start_id").alias("path"), F.lit(1.0).alias("score"))
    found: DataFrame | None = None
    for hop in range(1, hops + 1):
        if hop < hops:
            further = ties.meet(front, "at").where(~F.array_contains("path", F.col("b")) & (F.col("passable") | (F.col("b") == F.col("goal_id"))))
        else:
            last = ties.edges.select(F.col("a").alias("at"), F.col("b").alias("goal_id"), "factor")
            further = front.hint("merge").join(last, ["at", "goal_id"]).withColumn("b", F.col("goal_id"))
        score = F.col("score") * F.col("factor") * (1.0 if hop == 1 else damping)
        moved = further.select("start_id", "goal_id", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"), score.alias("score"))
        if hop < hops:
            moved = written(moved.hint("merge").join(bounds[hops - hop], ["goal_id", "at"]))
        arrived = moved.where("at = goal_id").select("start_id", "goal_id", "path", "score")
        found = checkpointed(_best(arrived if found is None else found.unionByName(arrived), keep).drop("place"))
        if hop == hops:
            break
        least = found.groupBy("start_id", "goal_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= keep)
        open_ = moved.where("at != goal_id").join(least, ["start_id", "goal_id"], "left")
        reaches = F.col("least").isNull() | (F.col("score") * F.col("best") >= F.col("least") - 10.0**-DIGITS)
        front = written(open_.where(reaches).drop("best", "n", "least"))
        if front.isEmpty():
            break
    return _told(g, _best(found, keep))


def _told(g: Graph, found: DataFrame) -> DataFrame:
    """Paths ``found`` (start_id, goal_id, place, path, score) with the statements of their steps, confidence and sources."""
    at = F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("n")
    gone = checkpointed(found.select("*", at).withColumns({"a": F.element_at("path", F.col("n")), "b": F.element_at("path", F.col("n") + 1)}))
    met = gone.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    between = (F.least("subject_id", "object_id") == F.col("x")) & (F.greatest("subject_id", "object_id") == F.col("y"))
    own = steps(replace(g, statements=g.statements.join(met, between, "left_semi"))).select("a", "b", "statement_id", "sources", "confidence")
    one = F.struct("n", "statement_id", "sources", "confidence")
    paths = gone.join(own, ["a", "b"]).groupBy("start_id", "goal_id", "place", "path", "score").agg(F.array_sort(F.collect_list(one)).alias("grounds"))  # as many as steps
    keys = F.array_distinct(F.transform("grounds", lambda x: x["sources"]))
    each = F.transform(keys, lambda k: F.array_min(F.transform(F.filter("grounds", lambda x: x["sources"] == k), lambda x: x["confidence"])))
    confidence = F.aggregate(each, F.lit(1.0), lambda acc, x: acc * x)
    sources = F.array_sort(F.array_distinct(F.flatten(keys)))
    ids = F.transform("grounds", lambda x: x["statement_id"])
    return paths.select("start_id", "goal_id", "place", "path", ids.alias("statement_ids"), "score", confidence.alias("confidence"), sources.alias("sources"))


def connections(paths: DataFrame) -> DataFrame:
    """(start_id, goal_id, n_paths, n_independent, best, confidence, strength) of the paths that ``best_paths`` found.

    strength is what all paths carry together, 1 - Π(1 - score). confidence is a noisy-or
    over independent paths alone: in order, each that shares no source with those taken before it.
    """
    path = F.struct("place", "score", "confidence", "sources")
    own = paths.groupBy("start_id", "goal_id").agg(F.array_sort(F.collect_list(path)).alias("paths"))  # ``keep`` paths at most
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(1.0).alias("doubt"), F.lit(0).alias("n"))

    def take(acc: Column, p: Column) -> Column:
        apart = ~F.arrays_overlap(acc["seen"], p["sources"])
        taken = F.struct(F.concat(acc["seen"], p["sources"]).alias("seen"), (acc["doubt"] * (1 - p["confidence"])).alias("doubt"), (acc["n"] + 1).alias("n"))
        return F.when(apart, taken).otherwise(acc)

    together = F.aggregate("paths", start, take)
    missing = F.aggregate("paths", F.lit(1.0), lambda acc, p: acc * (1 - p["score"]))
    return own.select(
        "start_id", "goal_id", F.size("paths").cast("long").alias("n_paths"), together["n"].cast("long").alias("n_independent"), F.col("paths")[0]["score"].alias("best"),
        (1 - together["doubt"]).alias("confidence"), (1 - missing).alias("strength"),
    )
