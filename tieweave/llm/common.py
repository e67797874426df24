"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import checkpointed, scratch_dir  # noqa: F401 (operators take checkpointed from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of this application below the shared one, which goes when the application ends."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"_tw_{name}"
        while candidate.lower() in taken:
            candidate = "_" + candidate
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column, and its name, that tells rows apart by id and text (by its hash).

    Rows with the same id and different texts, and rows without an id, have names of
    their own; rows equal in both share one. Names are ordered by id, null last.
    """
    (name,) = fresh(docs, "name")
    own = F.col(id_col)
    return docs.withColumn(name, F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64(text_col).alias("text"))), name


def id_name(id_col: str, results: Iterable[str]) -> str:
    """``id_col``, with as many times ``_id`` after it as it takes to be none of ``results``."""
    taken = {name.lower() for name in results}
    while id_col.lower() in taken:
        id_col += "_id"
    return id_col


def map_text(
    docs: DataFrame,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[T.StructField],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns computed from whole texts, one row for each input row.

    ``make`` runs once in a Python worker and returns a function from the texts of
    one Arrow batch to one array for each of ``fields``. Only the id and the text
    travel to Python and only the id and the results travel back. If that function has
    the attribute ``forget``, it is called when the task ends. An id column that has the
    name of a result is returned under ``id_name``.
    """
    schema = T.StructType([T.StructField(id_name(id_col, [f.name for f in fields]), docs.schema[id_col].dataType), *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for part in slices(batch):
                    columns = work(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)
        finally:
            getattr(work, "forget", int)()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


#: Texts of about so many bytes are held as Python objects at one time.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have SLICE_BYTES or one row each."""
    if batch.nbytes <= SLICE_BYTES:
        if batch.num_rows:
            yield batch
        return
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= SLICE_BYTES:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; TIEWEAVE_TOKENIZERS names another folder."""
    folder = os.environ.get("TIEWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
