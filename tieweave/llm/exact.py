"""Exact dedup by two passes over a Bloom filter, in DataFrame functions alone.

Pass one gives every row's text hash ``hashes`` slots among ``slots`` bits and counts
the rows on each slot. The slots with two rows or more are the filter, as bitmaps of
32,768 slots each. Pass two reads the rows again: a hash of which some slot is not in
the filter occurs once, and its row passes straight through; only rows with all slots in
the filter can have an equal and are shuffled by their hash to be counted exactly. Rows
that share slots by chance are counted too and found to be alone, so results are exact
whatever the size of the filter.

Size: SLOTS_PER_ROW slots for each row keep about one unique row in seventy in the
shuffle. The filter is broadcast, and its size is known before: slots / 8 bytes, never
above MAX_FILTER_BYTES. Beyond the number of rows for which that is enough, more rows
shuffle, up to all of them (a plain hash aggregation); nothing else changes. Passes
shuffle eight-byte slots and (hash, id) pairs, never texts.

Hot groups: equal rows are combined before each shuffle (slot counts, group sizes). Each
row gets its group's result by a join; groups with more than one row in HOT_GROUPS are at
most HOT_GROUPS in number, so theirs are broadcast, and no other group is large.
``groups`` hashes each text once and works on a table of hashes from there on.

Defined results: a null text equals the empty one; of equal texts the row with the
largest id stays, null being the least; rows equal in id and text are counted apart in
group_size and are kept or dropped together in ``groups``, while ``drop_exact``
keeps one row of each group; a very long text is hashed whole; an empty table gives no
rows. Further columns, whatever their names, are not read by ``groups`` and pass through
``drop_exact``; an id column that has the name of a result of ``groups`` comes back with
``_id`` after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, id_name, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 2
SLOTS_PER_ROW = 16
MAX_FILTER_BYTES = 256 << 20
#: Groups above this share of the rows (one in so many) are joined by broadcast.
HOT_GROUPS = 10_000
#: Fixed value: slots in one bitmap of Spark's bitmap functions.
BITMAP_SLOTS = 32_768


def normalised(text: Column) -> Column:
    """The text with A-Z alone in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def filter_slots(rows: int, slots_per_row: int = SLOTS_PER_ROW, max_bytes: int = MAX_FILTER_BYTES) -> int:
    """Slots for so many rows: whole bitmaps, within ``max_bytes``."""
    wanted = -(-max(rows, 1) * slots_per_row // BITMAP_SLOTS) * BITMAP_SLOTS
    return min(wanted, max(1, max_bytes * 8 // BITMAP_SLOTS) * BITMAP_SLOTS)


def _slot(digest: Column, k: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(slots))


def repeated_slots(digests: DataFrame, column: str, slots: int, hashes: int = HASHES) -> DataFrame:
    """Pass one: (bucket, bits), the bitmaps of all slots that two rows or more fall on."""
    slot = digests.select(F.explode(F.array(*(_slot(F.col(column), k, slots) for k in range(hashes)))).alias("slot"))
    twice = slot.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))


def maybe_repeated(rows: DataFrame, digest: str, bitmaps: DataFrame, slots: int, hashes: int = HASHES) -> tuple[DataFrame, str]:
    """``rows`` with a boolean column, and its name: all slots of the digest are in the filter."""
    columns, tests = rows.columns, []
    (maybe,) = fresh(rows, "maybe")
    for k in range(hashes):
        own, bucket, bits = fresh(rows, "slot", "bucket", "bits")
        found = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
        rows = rows.withColumn(own, _slot(F.col(digest), k, slots)).join(found, F.expr(f"bitmap_bucket_number({own}) = {bucket}"), "left")
        at = F.expr(f"bitmap_bit_position({own})")
        byte = F.conv(F.hex(F.substring(bits, F.expr(f"cast(bitmap_bit_position({own}) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    all_there = tests[0]
    for test in tests[1:]:
        all_there = all_there & test
    return rows.select(*columns, all_there.alias(maybe)), maybe


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    path = scratch_path(spark, "digests")
    docs.select(F.col(id_col).alias("_tw_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")).write.parquet(path)
    digests = spark.read.parquet(path)
    rows = digests.count()
    slots = filter_slots(rows, max_bytes=max_filter_bytes)
    bitmaps = repeated_slots(digests, "text_sha256", slots, hashes)
    tested, maybe = maybe_repeated(digests, "text_sha256", bitmaps, slots, hashes)
    tested = checkpointed(tested)  # probed once
    alone = tested.where(~F.col(maybe)).select("_tw_id", F.col("_tw_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    shared = tested.where(maybe).select("_tw_id", "text_sha256")
    sizes = checkpointed(shared.groupBy("text_sha256").agg(F.max("_tw_id").alias("keep_id"), F.count("*").alias("group_size")))
    # At most HOT_GROUPS groups can have more than one in HOT_GROUPS of all rows.
    hot = F.col("group_size") > rows // HOT_GROUPS
    large, small = F.broadcast(sizes.where(hot)), sizes.where(~hot)
    in_large = shared.join(large, "text_sha256")
    in_small = shared.join(large.select("text_sha256"), "text_sha256", "left_anti").join(small, "text_sha256")
    found = alone.unionByName(in_large).unionByName(in_small)
    own = id_name(id_col, ["keep_id", "group_size", "kept", "text_sha256"])
    return found.select(F.col("_tw_id").alias(own), "keep_id", "group_size", F.expr("_tw_id <=> keep_id").alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of equal texts.

    The row with the largest id stays; of rows with the same id, the one with the largest
    hash over the columns. Rows outside the filter pass straight through; the others
    shuffle by their hash, and each task combines the equal rows that it has before that.
    """
    (digest,) = fresh(docs, "digest")
    rows = docs.withColumn(digest, F.sha2(normalised(F.col(text_col)), 256))
    slots = filter_slots(docs.select(id_col).count(), max_bytes=max_filter_bytes)
    bitmaps = repeated_slots(rows, digest, slots, hashes)
    tested, maybe = maybe_repeated(rows, digest, bitmaps, slots, hashes)
    (row,) = fresh(tested, "row")
    alone = tested.where(~F.col(maybe)).select(*docs.columns)
    plain = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    order = F.struct(F.col(id_col), F.xxhash64(*plain))
    kept = tested.where(maybe).groupBy(digest).agg(F.max_by(F.struct(*docs.columns), order).alias(row)).select(f"{row}.*")
    return alone.unionByName(kept)
