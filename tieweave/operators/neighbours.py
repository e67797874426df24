"""Nearest vectors by cells: candidates for entities whose descriptions are embedded.

Equal vectors are one class, so a vector that a third of all rows have is one row here;
``classes`` says which rows a class stands for. ``cells`` are k-means centres of unit
vectors, fitted in numpy on SAMPLE classes at most, and as many as the root of the
classes up to MOST_CELLS, so what is sent to tasks has a bound (4096 centres of 64
numbers are 2 MB). Every class is put into the cell of its nearest centre; a query looks
into its nearest cells and compares itself with all that is in there, by exact cosines.
``exact`` compares blocks of queries with blocks of all classes; it tells the recall.

Rows whose vector is null, empty or zero, or has null or non-finite entries, are in no
class; so are vectors of another length than most have (of equally many, the longer).
Of equal cosines, rounded to nine places, the lesser id is first. Repeated rows are one
class, its id the least of its rows'; rows with a null id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 12
#: Members of the sample that are asked, and the share of their neighbours that the cells looked into hold.
ASKED, TARGET = 256, 0.95
#: Rows of a block in exact comparison.
BLOCK = 512


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row_id, class_id) of the rows that have a vector to compare."""
    own = _usable(vectors, id_col, vector_col)
    first = own.groupBy("raw").agg(F.min("row_id").alias("class_id"))
    return own.join(first, "raw").select("row_id", "class_id")


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row_id, raw) with doubles of one length."""
    finite = F.forall(F.col("raw"), lambda x: F.coalesce((x - x) == 0, F.lit(False))) & F.exists(F.col("raw"), lambda x: x != 0)
    # Adding zero makes one zero of both.
    own = vectors.select(F.col(id_col).alias("row_id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("raw"))
    own = own.where(F.col("row_id").isNotNull() & F.col("raw").isNotNull() & finite)
    usual = own.groupBy(F.size("raw").alias("n")).count().agg(F.max_by("n", F.struct("count", "n")).alias("usual"))  # one row
    return own.join(F.broadcast(usual), F.size("raw") == F.col("usual")).drop("usual")


def units(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(class_id, vector): one unit vector for each class."""
    first = _usable(vectors, id_col, vector_col).groupBy("raw").agg(F.min("row_id").alias("class_id"))
    # Scaled by its largest entry first, so that squares neither overflow nor vanish.
    most = F.array_max(F.transform("raw", lambda x: F.abs(x)))
    scaled = F.transform("raw", lambda x: x / F.col("most"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    own = first.withColumn("most", most).withColumn("scaled", scaled).withColumn("norm", norm)
    return own.select("class_id", F.transform("scaled", lambda x: x / F.col("norm")).alias("vector"))


@dataclass(frozen=True)
class Cells:
    """Centres as rows, and how many of the nearest a query looks into."""

    centres: np.ndarray
    probes: int


def fit(unit: DataFrame, keep: int = 10, target: float = TARGET) -> Cells:
    """Cells from a bounded sample in hash order; the same ones for the same classes.

    ASKED of the sample are asked for their nearest in the sample, and ``probes`` is the
    least number of cells that holds ``target`` of these. Vectors without any order need
    many. More classes than the sample has lie closer, so they need no more.
    """
    total = unit.count()
    n_cells = int(min(MOST_CELLS, max(1, round(total**0.5))))
    sample = unit.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).toPandas()
    if sample.empty:
        return Cells(np.zeros((0, 0)), 0)
    points = np.stack(sample["vector"].to_numpy())
    centres = points[: min(n_cells, len(points))].copy()
    for _ in range(ROUNDS):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    held = (points @ centres.T).argmax(axis=1)
    asked = points[-min(ASKED, len(points)) :]  # the others were the first centres
    cosines = asked @ points.T
    cosines[np.arange(len(asked)), np.arange(len(points) - len(asked), len(points))] = -np.inf
    nearest = np.argsort(-cosines, axis=1, kind="stable")[:, : min(keep, len(points) - 1)]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    needed = np.sort(np.take_along_axis(place, held[nearest], 1).ravel())
    return Cells(centres, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else 1)


def _placed(unit: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """``unit`` with ``cell``, a row for each of the ``n`` nearest centres."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.argsort(-(np.stack(batch["vector"].to_numpy()) @ centres.T), axis=1, kind="stable")[:, :n]
                yield batch.assign(cells=list(near.astype(np.int32)))

    id_type = unit.schema["class_id"].dataType.simpleString()
    found = unit.mapInPandas(place, f"class_id {id_type}, vector array<double>, cells array<int>")
    return found.select("class_id", "vector", F.explode("cells").alias("cell"))


def _nearest(met: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each query. met: (query_id, neighbour_id, similarity)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def nearest(queries: DataFrame, unit: DataFrame, keep: int = 10, cells: Cells | None = None) -> DataFrame:
    """(query_id, neighbour_id, similarity, place) of the nearest other classes in the cells that a query looks into."""
    cells = cells or fit(unit, keep)
    if len(cells.centres) == 0:
        return _nearest(_none(unit), keep)
    asked, held = _placed(queries, cells.centres, cells.probes), _placed(unit, cells.centres, 1)
    met = _packed(asked, "q").join(_packed(held, "u"), "cell").drop("cell")
    return _nearest(_first(met, unit, keep), keep)


def _packed(placed: DataFrame, side: str) -> DataFrame:
    """Rows of a cell in blocks of BLOCK on average, each block one row."""
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")))
    return dealt.groupBy("cell", "part").agg(F.collect_list("class_id").alias(f"{side}_ids"), F.flatten(F.collect_list("vector")).alias(f"{side}_vectors")).drop("part")


def _first(met: DataFrame, unit: DataFrame, keep: int) -> DataFrame:
    """(query_id, neighbour_id, similarity): of each pair of blocks the ``keep`` nearest of each query, and what is equal to the last of them."""
    id_type = unit.schema["class_id"].dataType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q, ids, v in zip(batch["q_ids"], batch["q_vectors"], batch["u_ids"], batch["u_vectors"], strict=True):
                q_ids, ids = np.asarray(q_ids), np.asarray(ids)
                found = np.round(np.asarray(q).reshape(len(q_ids), -1) @ np.asarray(v).reshape(len(ids), -1).T, 9)
                found[q_ids[:, None] == ids[None, :]] = -np.inf
                last = np.partition(found, max(0, len(ids) - keep), axis=1)[:, max(0, len(ids) - keep)]
                row, column = np.nonzero((found >= last[:, None]) & (found > -np.inf))
                yield pd.DataFrame({"query_id": q_ids[row], "neighbour_id": ids[column], "similarity": found[row, column]})

    return met.select("q_ids", "q_vectors", "u_ids", "u_vectors").mapInPandas(compare, f"query_id {id_type}, neighbour_id {id_type}, similarity double")


def _none(unit: DataFrame) -> DataFrame:
    return unit.select(F.col("class_id").alias("query_id"), F.col("class_id").alias("neighbour_id"), F.lit(0.0).alias("similarity")).limit(0)


def exact(queries: DataFrame, unit: DataFrame, keep: int = 10) -> DataFrame:
    """What ``nearest`` gives if every query looks everywhere: blocks of queries against blocks of all classes, as matrices."""
    def blocks(df: DataFrame, side: str) -> DataFrame:
        n_blocks = F.broadcast(df.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).alias("n")))  # one row
        dealt = df.crossJoin(n_blocks).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("n")))
        return dealt.groupBy("block").agg(F.collect_list("class_id").alias(f"{side}_ids"), F.flatten(F.collect_list("vector")).alias(f"{side}_vectors")).drop("block")

    # A stated query set against all rows, in blocks.
    return _nearest(_first(blocks(queries, "q").crossJoin(blocks(unit, "u")), unit, keep), keep)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_true, n_found, recall of the true neighbours."""
    hit = found.select("query_id", "neighbour_id", F.lit(1).alias("hit"))
    counts = truth.join(hit, ["query_id", "neighbour_id"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.round(F.try_divide("n_found", "n_true"), 6))
