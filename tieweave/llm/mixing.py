"""Mixing of sources to target weights by systematic sampling.

The sources share all words by weight; a source's target stops at ``most`` times its
words, and what it leaves is shared by weight among the others until none is above. In
the order of words a unit of weight, the sources that stop come first, so running sums
over the sources (``operators/ranks.py``) find the share of a unit of weight at one stroke, in
whole numbers, without a loop and without a table of sources on the driver.

Within a source each document is expected target / words times. Those expected copies are
summed over the documents in order, one random offset for each source is added, and a document
is emitted once for each whole number that its sum crosses. So a document has its expected
copies rounded down or up, never above ``most``. Documents lie in order of size, which
makes what a source's mix takes miss its target by one largest document at most, whatever the
offset. Sums and offsets are fractions with one denominator for each source, so nothing
is rounded and reruns agree.

Documents are dealt out by ranges of (source, size, hash of the id): a source of any share is
spread over tasks, and a document's place in its source is its place in its task plus what
comes before that task, from a table of one row for each source in each task. Rows that are
equal in all of these are dealt out by their place in the input.

Defined results: a null or blank text has size 0 and is taken 0 words, whatever its copies;
null is a source of its own, the last; a very long text counts whole; a null id sorts last among
equal sizes; rows that repeat are each drawn on their own, and which one of equal rows is
drawn makes no difference; an empty table gives no rows; without any word all targets are
0. Other columns pass through ``mixed`` untouched; an id column that has the name of a
result of ``plan`` comes back with ``_id`` after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import placed, running
from .common import fresh, id_name, scratch_path

WEIGHTS = (1, 2, 3)
MOST = 3
#: Offsets are drawn among so many.
OFFSETS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text_col: str, size: str) -> DataFrame:
    """``docs`` with the number of words of the text, the last column, as ``size`` in its place."""
    columns = docs.columns[:-1]
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField(size, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.fill_null(pc.count_substring_regex(batch.column(len(columns)), WORD), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=schema.names)

    return docs.mapInArrow(run, schema)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, words, over, under) of (source, words): the target of a source is over / under words.

    Sources by code point, null last, weigh ``weights`` in turn.
    """
    exact = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    numbered = placed(sizes, F.asc_nulls_last("source"))
    turn = (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long"))
    sums = weighed.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("all_words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weight"))  # one row
    # In the order of words a unit of weight (six digits; sources that tie stop or don't together).
    order = [F.col("words").cast("decimal(20,0)") / F.col("weight").cast("decimal(6,0)"), F.col("place")]
    before = running(weighed.select("source", "words", "weight", "place"), order, {"words_before": F.col("words"), "weight_before": F.col("weight")})
    known = before.crossJoin(F.broadcast(sums))
    known = known.withColumn("words_left", exact(exact("all_words") - most * exact("words_before"))).withColumn("weight_left", exact(exact("all_weight") - exact("weight_before")))
    stops = exact(F.col("words_left") * F.col("weight")) > exact(most * exact("words") * F.col("weight_left"))
    known = known.withColumn("stops", stops)
    # The first source that does not stop has the share of all from there on.
    share = known.where("not stops").agg(F.min_by(F.struct("words_left", "weight_left"), "weight_before").alias("share"))  # one row
    level = known.crossJoin(F.broadcast(share))
    over = F.when(F.col("stops"), exact(most * exact("words"))).otherwise(exact(F.col("share.words_left") * F.col("weight")))
    return level.select("source", "words", over.alias("over"), F.when(F.col("stops"), exact(F.lit(1))).otherwise(F.col("share.weight_left")).alias("under"))


def offset(source: Column, seed: int) -> Column:
    """A number below OFFSETS for each source."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("long")


def _drawn(docs: DataFrame, carried: list[str], id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``docs`` with the ``carried`` columns and, under names that none of them has, size, words, target and copies."""
    spark = docs.sparkSession
    names = ("key", "source", "text", "size", "spread", "row", "part", "at", "first", "ahead", "goal", "words", "over", "under", "place", "bound", "copies", "target")
    own = dict(zip(names, fresh(docs, *names)))
    col = {name: F.col(c) for name, c in own.items()}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shown = [*carried, F.col(id_col).alias(own["key"]), F.col(source_col).cast("string").alias(own["source"]), F.monotonically_increasing_id().alias(own["spread"])]
    rows = sized(docs.select(*shown, F.col(text_col).alias(own["text"])), own["text"], own["size"])
    if text_col not in carried:  # dealing out by ranges reads its input twice
        rows = _written(rows, "sizes")
    order = [F.asc_nulls_last(own["source"]), F.desc(own["size"]), F.asc_nulls_last(F.md5(col["key"].cast("string"))), F.asc_nulls_last(own["key"]), F.asc(own["spread"])]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(own["spread"])
    rows = _written(dealt.withColumn(own["part"], F.spark_partition_id()).withColumn(own["row"], F.monotonically_increasing_id()), "dealt")
    counts = rows.groupBy(own["source"], own["part"]).agg(F.count("*").alias("n"), F.min(own["row"]).alias(own["first"]), F.sum(own["size"]).alias("words"))
    counts = _written(counts, "counts")
    goals = targets(counts.groupBy(col["source"].alias("source")).agg(F.sum("words").alias("words")), weights, most)
    goals = goals.select(*(F.col(c).alias(own[o]) for c, o in (("source", "goal"), ("words", "words"), ("over", "over"), ("under", "under"))))
    earlier = Window.partitionBy(own["source"]).orderBy(own["part"]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(own["source"], own["part"], own["first"], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(own["ahead"]))
    known = ahead.join(goals, col["source"].eqNullSafe(col["goal"])).withColumnRenamed(own["part"], own["at"]).drop(own["source"])
    found = rows.join(known, col["source"].eqNullSafe(col["goal"]) & (col["part"] == col["at"]))
    exact = lambda c: c.cast("decimal(38,0)")
    # A document is expected over / (under * words) times. With all times OFFSETS, offsets are whole, too.
    bound = exact(col["under"] * col["words"])
    found = found.withColumns({own["place"]: exact(col["ahead"] + col["row"] - col["first"]), own["bound"]: bound})
    start, step = f"{own['bound']} * {{at}}", f"{own['over']} * {OFFSETS}"
    found = found.withColumn(own["at"], offset(col["source"], seed))
    sum_at = lambda k: f"cast({start.format(at=own['at'])} + ({own['place']} + {k}) * {step} as decimal(38,0)) div cast({own['bound']} * {OFFSETS} as decimal(38,0))"
    some = col["words"] > 0
    copies = F.when(some, F.expr(f"({sum_at(1)}) - ({sum_at(0)})")).otherwise(0)
    target = F.when(some, col["over"].cast("double") / col["under"].cast("double")).otherwise(0.0)
    found = found.withColumn(own["copies"], copies).withColumn(own["target"], target)
    return found.select(*carried, *(own[c] for c in ("size", "words", "target", "copies"))), own


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def plan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42
) -> DataFrame:
    """One row for each row: id, size, source_size, target, copies, taken (words). Only ids, sources and sizes are shuffled."""
    found, own = _drawn(docs, [id_col], id_col, text_col, source_col, weights, most, seed)
    key = id_name(id_col, ["size", "source_size", "target", "copies", "taken"])
    size, copies = F.col(own["size"]), F.col(own["copies"])
    return found.select(
        F.col(id_col).alias(key), size.alias("size"), F.col(own["words"]).alias("source_size"), F.col(own["target"]).alias("target"), copies.alias("copies"), (size * copies).alias("taken")
    )


def mixed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42
) -> DataFrame:
    """The mix: the rows of ``docs``, all columns, each as many times as it is drawn. Texts are shuffled once and counted twice."""
    found, own = _drawn(docs, docs.columns, id_col, text_col, source_col, weights, most, seed)
    copies = F.col(own["copies"])
    return found.where(copies > 0).withColumn(own["copies"], F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
