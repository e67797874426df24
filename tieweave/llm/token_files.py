"""Token files: Parquet list columns with small row groups and page indexes.

Documents lie in ascending order of id over all files. A file holds per document its id,
its number of ids, the ids before it within its partition and the ids as a list column;
the order of partitions gives the place of each document in the whole stream. The list
is dictionary encoded while the dictionary is small and delta encoded after that
(version 2 pages). Row groups and pages are small and every page has an entry in the
page index, so a reader of a few documents (``read_documents``), or of lengths alone
(``read_lengths``), fetches a few pages.

Defined results: a null or empty text is the end id alone; a very long text is one row;
a null id sorts first; documents with the same id are ordered by a hash of their texts,
equal ones are interchangeable; an empty table gives no files' rows; other columns are
not read. An id column that has the name of a result comes back with ``_id`` after it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_name, slices, tokenizer_path
from .matches import library_encoder, with_end

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 64
#: What the files and their readers add to the id.
RESULTS = ("part", "part_start", "n_tokens", "ids", "start", "ids_crc32")


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Writes ``docs`` as token files to ``path``, a folder that all executors share.

    Columns: id, part, part_start, n_tokens, ids. Texts are dealt out by ranges of the
    id (sampled bounds, no single task), so a hot source or group of copies is spread.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or tokenizer_path(VOCABULARY)
    owner = id_name(id_col, RESULTS)
    schema = T.StructType(
        [
            T.StructField(owner, docs.schema[id_col].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("part_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        number, at = TaskContext.get().partitionId(), 0
        try:
            for batch in batches:
                for part in slices(batch):
                    flat, ends = with_end(*encoder.encode_array(part.column(1)), end_id)
                    ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                    numbers = pa.array(np.full(len(ids), number, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), numbers, pa.array(at + ends[:-1]), pa.array(np.diff(ends)), ids], names=schema.names)
                    at += int(ends[-1])
        finally:
            encoder.forget()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (tie,) = fresh(docs, "tie")
    ordered = docs.select(id_col, text_col).withColumn(tie, F.xxhash64(text_col)).repartitionByRange(n, F.col(id_col).asc_nulls_first(), F.col(tie))
    tokens = ordered.sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col(tie)).select(id_col, text_col).mapInArrow(run, schema)
    (
        tokens.write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files with ``start``, the ids of all documents before each.

    The sums by partition are one row for each partition that was written; they alone
    meet in one task. Columns that aren't selected later are not read.
    """
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("part"), F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("_tw_before"))
    return files.join(F.broadcast(starts), "part").withColumn("start", F.col("_tw_before") + F.col("part_start")).drop("_tw_before")


def read_lengths(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens) of every document, from the pages of those columns alone."""
    return read_token_files(spark, path).select(id_col, "start", "n_tokens")


def read_documents(spark: SparkSession, path: str, first: object, last: object, id_col: str = "doc_id") -> DataFrame:
    """The rows with an id from ``first`` to ``last``.

    Files lie in the order of ids, so all row groups but a few are left out by their
    statistics, and all pages but a few of those by the page index.
    """
    return read_token_files(spark, path).where(F.col(id_col).between(first, last))


def with_crc32(tokens: DataFrame, *, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ids_crc32 of the list column ``ids``, as unsigned 32-bit."""
    schema = T.StructType([*(tokens.schema[c] for c in keep), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            ends = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            sums = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sums, pa.int64())], names=schema.names)

    return tokens.select(*keep, "ids").mapInArrow(run, schema)
