"""Nearest vectors: exact blocks against all pairs, cells by their recall, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieweave.operators import neighbours

ROWS = "vec_id long, embedding array<float>"


def made(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], ROWS)


def plain(points, asked, keep):
    """Of rows that are all different."""
    unit = points.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = set()
    for q in asked:
        cosines = np.round(unit @ unit[q], 9)
        found |= {(q, int(i)) for i in [i for i in np.lexsort((np.arange(len(unit)), -cosines)) if i != q][:keep]}
    return found


def of(df):
    return {(r["query_id"], r["neighbour_id"]) for r in df.collect()}


def test_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    points = np.random.default_rng(1).normal(size=(300, 8))
    unit = neighbours.units(made(spark, points))
    assert of(neighbours.exact(unit.where("class_id % 20 = 0"), unit, 5)) == plain(points, range(0, 300, 20), 5)


@pytest.mark.parametrize("spread", [0.2, 5.0])
def test_recall_of_cells(spark, spread):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(12, 16))[rng.integers(0, 12, 1200)] + spread * rng.normal(size=(1200, 16))
    unit = neighbours.units(made(spark, points)).cache()
    asked = unit.where("class_id % 20 = 0")
    cells = neighbours.fit(unit)
    found = neighbours.recall(neighbours.nearest(asked, unit, 10, cells), neighbours.exact(asked, unit, 10)).first()
    assert found["n_true"] == 600 and found["recall"] >= 0.9
    # Where vectors lie in groups, few cells do.
    assert (cells.probes < len(cells.centres) / 3) == (spread < 1)


def test_equal_vectors_are_one_class(spark):
    points = np.random.default_rng(3).normal(size=(60, 4))
    df = made(spark, points).unionByName(spark.range(1000, 1900).select(F.col("id").alias("vec_id"), F.array(*(F.lit(float(x)).cast("float") for x in points[7])).alias("embedding")))
    assert neighbours.classes(df).where("class_id = 7").count() == 901
    unit = neighbours.units(df)
    assert unit.count() == 60
    found = neighbours.nearest(unit, unit, 3)
    assert found.where("query_id = neighbour_id").count() == 0 and found.where("place > 3").count() == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [3.0, 1.0]), (9, [-0.0, 2.0]), (10, [3e38, 3e38])]
    df = spark.createDataFrame(rows, ROWS).withColumns({"raw": F.lit(1), "n": F.lit(2)})
    assert {(r["row_id"], r["class_id"]) for r in neighbours.classes(df).collect()} == {(0, 0), (1, 1), (9, 1), (10, 10)}
    unit = neighbours.units(df)
    assert of(neighbours.exact(unit, unit, 1)) == {(0, 10), (1, 10), (10, 0)}
    none = neighbours.units(df.limit(0))
    assert neighbours.exact(none, none).count() == 0 and neighbours.nearest(none, none).count() == 0
    assert neighbours.recall(neighbours.nearest(none, none), neighbours.exact(none, none)).first()["recall"] is None
    one = unit.where("class_id = 0")
    assert neighbours.nearest(one, one).count() == 0 and neighbours.exact(one, one).count() == 0


def test_cells_hand_on_only_the_nearest_of_a_block(spark):
    """Of a cell that holds all vectors, a query's ``keep`` nearest go on from each block, not each vector."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    unit = neighbours.units(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    cells = neighbours.Cells(np.ones((1, 6)), 1)
    asked = unit.where("class_id % 20 = 0")
    placed = [neighbours._packed(neighbours._placed(x, cells.centres, 1), side) for x, side in ((asked, "q"), (unit, "u"))]
    assert neighbours._first(placed[0].join(placed[1], "cell"), unit, 4).count() == 15 * 4
    found, truth = (sorted(tuple(r) for r in f.collect()) for f in (neighbours.nearest(asked, unit, 4, cells), neighbours.exact(asked, unit, 4)))
    assert found == truth and len(found) == 15 * 4
