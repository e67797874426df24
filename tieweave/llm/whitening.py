"""Whitening of embeddings from an exact integer scatter.

Entries become whole numbers, floor(scale * entry). The fit counts every different vector
once. Each task works on blocks of BLOCK_ROWS vectors: it subtracts a shift (the block's
rounded mean, so that products are small and machine numbers hold them exactly), sums the
vectors and their products, and adds the shift's part back in whole numbers of any size.
What tasks find is cut into limbs of 32 bits, which Spark sums, so the totals S and XᵀX
are exact whatever the number of vectors and tasks. n·XᵀX - SSᵀ is formed from them in whole
numbers, too; only then is it divided by n² to a float matrix, which ``eigh`` decomposes.

What reaches the driver is limbs of d sums and d (d + 1) / 2 products, which depends on the
number d of entries alone, never on the rows; what is broadcast is the model. The one
shuffle of vectors is that of the different ones, copies being combined before it.

Defined results: rows whose vector is null, or holds null, NaN or infinite entries, go; so
do vectors with another number of entries than most have (of equal counts, the most
entries), as they can't be compared. Entries beyond the range of a long are its ends.
Repeated rows and null ids are each scored on their own. Components whose variance is no
more than rounding (d · 2⁻⁵² of the largest) don't count, so there may be fewer than asked
for, none if all vectors are equal; then there are no rows, as for an empty table.
Eigenvectors have their largest entry positive. Other columns are not read; an id column
that has the name of a result comes back with ``_id`` after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_name, scratch_path

SCALE = 256
BLOCK_ROWS = 4096
LIMB = 32
#: Whole numbers up to here are exact as floats, and up to WHOLE as machine integers.
EXACT, WHOLE = 1 << 53, 1 << 63


@dataclass(frozen=True)
class Whitening:
    """What a fit has found. n vectors with exact ``sums``; eigenvalues fall; axes are columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def quantised(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): the rows with a sound vector, whose entries are floor(scale * entry) as long."""
    entry = lambda c: c.cast("double")
    sound = F.forall(vector_col, lambda c: F.coalesce(~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")), F.lit(False)))
    known = rows.where(F.col(vector_col).isNotNull() & sound).select(F.col(id_col), F.col(vector_col).alias("_tw_vector"))
    least, most = F.lit(float(-WHOLE)), F.lit(float(WHOLE - 1024))  # the ends of a long, as floats
    whole = F.transform("_tw_vector", lambda c: F.floor(F.greatest(least, F.least(most, scale * entry(c)))))
    return known.select(F.col(id_col).alias("_tw_id"), whole.alias("x"))


def limbs(number: int) -> list[int]:
    """``number`` in limbs of LIMB bits, least first, all with its sign."""
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _products(x: np.ndarray, most: int) -> np.ndarray:
    """xᵀx in whole numbers of any size; ``most`` is the largest absolute entry."""
    bound = len(x) * most * most
    if bound < EXACT:
        return (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64).astype(object)
    if bound < WHOLE:
        return (x.T @ x).astype(object)
    big = x.astype(object)
    return big.T @ big


def block_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact sums and products of the rows of ``x`` (int64), as whole numbers of any size."""
    m = len(x)
    low, high = x.min(axis=0).astype(object), x.max(axis=0).astype(object)
    shift = (low + high) // 2  # near the mean of what the block holds, and never out of range
    if max(high - low, default=0) < WHOLE:
        moved = x - shift.astype(np.int64)
        most = int(np.abs(moved).max(initial=0))
        sums = moved.sum(axis=0).astype(object) if m * most < WHOLE else moved.astype(object).sum(axis=0)
        products = _products(moved, most)
    else:
        moved = x.astype(object) - shift
        sums, products = moved.sum(axis=0), moved.T @ moved
    cross = np.outer(sums, shift)
    return sums + m * shift, products + cross + cross.T + m * np.outer(shift, shift)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, XᵀX) of all rows of ``vectors`` (x: d longs each), exact. The driver gets d (d + 3) / 2 numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column(0).slice(i, BLOCK_ROWS), d)
                s, p = block_scatter(x)
                n, sums, products = n + len(x), sums + s, products + p
        found = [(-1, -1, n), *((-1, j, sums[j]) for j in range(d)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
        rows = [(i, j, k, limb) for i, j, number in found for k, limb in enumerate(limbs(int(number)))]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "limb"])

    parts = vectors.select("x").mapInArrow(run, "i int, j int, k int, limb long")
    totals: dict[tuple[int, int], int] = {}
    for i, j, k, limb in parts.groupBy("i", "j", "k").agg(F.sum("limb").alias("limb")).collect():
        totals[i, j] = totals.get((i, j), 0) + (limb << (LIMB * k))
    whole = [[totals.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)]
    return totals.get((-1, -1), 0), [totals.get((-1, j), 0) for j in range(d)], whole


def decomposed(n: int, sums: list[int], products: list[list[int]], components: int) -> Whitening:
    """The largest components of the covariance (n·XᵀX - SSᵀ) / n²."""
    d = len(sums)
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[value / (n * n) for value in row] for row in exact], dtype=np.float64).reshape(d, d)
    values, axes = np.linalg.eigh(covariance) if d else (np.zeros(0), np.zeros((0, 0)))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    there = values > d * np.finfo(np.float64).eps * values.max(initial=0)
    values, axes = values[there], axes[:, there]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]) if axes.size else np.ones(0)
    trace = sum(exact[i][i] for i in range(d)) / (n * n) if n else 0.0
    return Whitening(n, sums, values, axes * signs, trace)


def centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int]]:
    """(x - S/n as floats, the exact sums over entries of (n·x - S)²) for each row of ``x``."""
    n, d = model.n, len(model.sums)
    bound = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, model.sums), default=0)
    if d * bound * bound < WHOLE:
        apart = n * x - np.array(model.sums, dtype=np.int64)
        return apart / n, (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(model.sums, dtype=object)
    return np.array(apart / n, dtype=np.float64).reshape(x.shape), (apart * apart).sum(axis=1).tolist()


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model)[0] @ (model.axes / np.sqrt(model.values))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over all ``vectors``.

    Whitened vectors are about their exact mean, which is zero; one row of sums a task reaches the driver.
    """
    d, c = len(model.sums), len(model.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                w = whitened(_matrix(batch.column(0).slice(i, BLOCK_ROWS), d), model)
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        flat = [*sums.tolist(), *products.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["place", "part"])

    found = dict(vectors.select("x").mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part")).collect())
    mean = np.array([found[i] for i in range(c)]) / model.n
    covariance = np.array([found[i] for i in range(c, c + c * c)]).reshape(c, c) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(c)).max(initial=0))


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """One row for each sound row and component: id, component, n, deviation, whitened, explained, identity_error.

    deviation, the exact sum over entries of (n·x - S)², is a text of digits, as it outgrows any type.
    """
    spark = rows.sparkSession
    results = [
        T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.StringType()),
        *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")),
    ]
    schema = T.StructType([T.StructField(id_name(id_col, [f.name for f in results]), rows.schema[id_col].dataType), *results])
    path = scratch_path(spark, "whole-vectors")
    quantised(rows, id_col=id_col, vector_col=vector_col, scale=scale).write.parquet(path)
    whole = spark.read.parquet(path)
    most = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None or not most.d:
        return spark.createDataFrame([], schema)
    d = most.d
    whole = whole.where(F.size("x") == d)
    path = scratch_path(spark, "different-vectors")
    whole.select("x").distinct().write.parquet(path)
    different = spark.read.parquet(path)
    model = decomposed(*scatter(different, d), components)
    if not len(model.values):
        return spark.createDataFrame([], schema)
    error = identity_error(different, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(model.values)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                x = _matrix(part.column(1), d)
                about, deviations = centred(x, model)
                projected = about @ (model.axes / np.sqrt(model.values))
                m = len(x)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, model.n)),
                    pa.array([str(v) for v in deviations for _ in range(c)], pa.string()), pa.array(projected.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * c, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return whole.select("_tw_id", "x").mapInArrow(run, schema)
