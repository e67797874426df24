"""Packing by power-of-two decomposition.

Each document becomes token ids with an end id, and its length is written as a sum of
powers of two: whole sequences of ``max_length`` first, then one piece for each binary
digit of the rest, longest first. Every piece is a sequence of its own, so no sequence
crosses documents. Pieces are then put into buckets of equal length, one folder for each
length, which are trained on without padding. Nothing is shuffled: each task writes its
own files in each bucket, so no bucket meets in one task.

Defined results: a null or empty text is the end id alone (one piece of length 1); a
very long text gives as many sequences as it needs, handed on in parts; rows that repeat,
also with the same id, are packed each on their own; a null id stays null; an empty table
gives an empty result; other columns of the input are not read. An id column that has the
name of a result comes back with ``_id`` after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_name, scratch_path, slices, tokenizer_path
from .matches import library_encoder, with_end

MAX_LENGTH = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Pieces are handed on in batches of about so many bytes.
BATCH_BYTES = 16 << 20


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: powers of two, falling, with sum ``n``."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _in_batches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of places whose ``sizes`` add up to about BATCH_BYTES."""
    number = np.cumsum(sizes) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return ((i, j) for i, j in zip(cuts, cuts[1:]) if i < j)


def cut_powers_of_two(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ids holds the token ids as little-endian unsigned 32-bit bytes. sequence_id is
    unique; it depends on the order of the input's partitions alone, so a task that is
    run again gives the same ids. ``max_length`` is a power of two.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    vocabulary = vocabulary or tokenizer_path(VOCABULARY)
    long = T.LongType()
    results = ["start", "length", "ids", "doc_tokens"]
    kinds = dict.fromkeys(results, long) | {"ids": T.BinaryType()}
    owner = id_name(id_col, [*results, "sequence_id", "offset", "bucket"])
    schema = T.StructType([T.StructField(owner, docs.schema[id_col].dataType), *(T.StructField(c, kinds[c]) for c in results)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        try:
            for batch in batches:
                for part in slices(batch):
                    ids, ends = with_end(*encoder.encode_array(part.column(1)), end_id)
                    totals = np.diff(ends)
                    cut = [piece_lengths(n, max_length) for n in totals.tolist()]
                    lengths = np.array([x for own in cut for x in own], dtype=np.int64)
                    rows = np.repeat(np.arange(len(cut)), [*map(len, cut)])
                    begins = np.cumsum(lengths) - lengths
                    for i, j in _in_batches(4 * lengths):
                        own, low = rows[i:j], begins[i]
                        raw = pa.py_buffer(ids[low : begins[j - 1] + lengths[j - 1]].tobytes())
                        offsets = (4 * (np.append(begins[i:j], begins[j - 1] + lengths[j - 1]) - low)).astype(np.int32)
                        pieces = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), raw])
                        numbers = [pa.array(x) for x in (begins[i:j] - ends[own], lengths[i:j], totals[own])]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), *numbers[:2], pieces, numbers[2]], names=schema.names)
        finally:
            encoder.forget()

    pieces = docs.select(id_col, text_col).mapInArrow(run, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet files in one folder for each length, log2(max_length) + 1 folders at most."""
    lengths = pieces.withColumn("bucket", F.col("length"))
    lengths.write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, lengths: list[int] | None = None) -> DataFrame:
    """The sequences in the buckets of ``lengths`` (all), with the columns of ``schema``."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.LongType())])).parquet(path)
    if lengths is not None:
        found = found.where(F.col("bucket").isin(lengths))
    return found.drop("bucket")


def pack_powers_of_two(docs: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """The sequences of ``docs``, from buckets written to ``path`` (a new folder in the shared one)."""
    path = path or scratch_path(docs.sparkSession, "buckets")
    pieces = cut_powers_of_two(docs, **options)
    write_buckets(pieces, path)
    return read_buckets(docs.sparkSession, path, pieces.schema)
