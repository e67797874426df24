"""Chat formatting of logged conversations, with collapse of cumulative snapshots.

A log often holds a conversation once after each turn. Every turn gets the hash of all
turns up to it (``prefix``), a running exclusive-or of hashes of position, role and
text. A conversation whose whole hash is the hash of a proper prefix of a longer one is
a snapshot of that one and goes; of conversations with the same turns the least id stays
with the number of copies. What is left is maximal and is rendered.

Rendering is by turn: a segment for each turn, so no conversation is gathered into one
row. ``documents`` joins the segments for consumers that want one row a conversation.

Positions and running hashes are found on digests of turns, without their texts, dealt out
by ranges of (conversation, turn): a conversation of any length lies in as many partitions
as it takes. Windows run within a partition; what a conversation has before it comes
from sums over its partitions, and as only conversations that go over the edge of a
partition need them, that table has fewer rows than twice the partitions and is broadcast.
Texts are shuffled once, by the whole turn, to meet their positions. Equal turns are counted
before they are dealt out. Prefixes and whole conversations are made distinct before they
meet, so a first turn or a conversation that a third of the log shares is one row for each
task.

Defined results: turns are ordered by turn number, null first, then role and SHA-256 of the
text; a null role or text is the empty string; a null id is one conversation like any
other; rows that repeat are turns of their own; very long texts and conversations are
taken whole; an empty table gives no rows; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _key() -> Column:
    """What tells turns apart, in the order of turns; a struct is equal to another where both have a null."""
    return F.struct("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"))


def _plain(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return rows.select(_key().alias("key"), "text")


def _spanning(rows: DataFrame, sums: dict[str, Column], merge) -> DataFrame:
    """(conv, part, before_<name>, all_<name>) of conversations in several partitions, fewer than twice the partitions.

    sums: aggregates of a partition's rows. merge: the aggregate that puts such together.
    """
    parts = rows.groupBy("conv", "part").agg(*(c.alias(name) for name, c in sums.items()))
    several = parts.groupBy("conv").agg(F.count("*").alias("n_parts")).where("n_parts > 1").select("conv")
    own = parts.join(several, "conv", "left_semi")
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    columns = [x for name in sums for x in (F.coalesce(merge(name).over(earlier), F.lit(0)).alias(f"before_{name}"), merge(name).over(whole).alias(f"all_{name}"))]
    return own.select("conv", "part", *columns)


def turn_hashes(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, position from 1, n_turns, prefix1, prefix2) for each turn.

    prefix1 and prefix2 are independent 64-bit hashes of all turns up to this one.
    """
    counted = _plain(turns, id_col, turn_col, role_col, text_col).groupBy("key").agg(F.count("*").alias("c"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(n, "key").select("key", "c", F.struct("key.conv_id").alias("conv"), F.spark_partition_id().alias("part"))
    dealt = checkpointed(dealt)
    offsets = F.broadcast(_spanning(dealt, {"c": F.sum("c")}, F.sum))
    here = Window.partitionBy("conv", "part")
    earlier = here.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("own", F.coalesce(F.sum("c").over(earlier), F.lit(0))).withColumn("whole", F.sum("c").over(here))
    joined = local.join(offsets, ["conv", "part"], "left")
    first = F.col("own") + F.coalesce("before_c", F.lit(0)) + 1
    placed = joined.select("conv", "part", "key", F.coalesce("all_c", "whole").alias("n_turns"), F.explode(F.sequence(first, first + F.col("c") - 1)).alias("position"))
    own = [F.xxhash64(F.lit(k), "position", "key.role", "key.digest").alias(f"h{k}") for k in (1, 2)]
    placed = checkpointed(placed.select("*", *own))
    offsets = F.broadcast(_spanning(placed, {f"h{k}": F.bit_xor(f"h{k}") for k in (1, 2)}, F.bit_xor).drop("all_h1", "all_h2"))
    so_far = here.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv", "part", "key", "position", "n_turns", *(F.bit_xor(f"h{k}").over(so_far).alias(f"h{k}") for k in (1, 2)))
    joined = local.join(offsets, ["conv", "part"], "left")
    prefixes = [F.col(f"h{k}").bitwiseXOR(F.coalesce(f"before_h{k}", F.lit(0))).alias(f"prefix{k}") for k in (1, 2)]
    return joined.select("conv", "key", "position", "n_turns", *prefixes)


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv, copies) of the conversations that stay, from ``turn_hashes``."""
    whole = hashed.where("position = n_turns").select("conv", "position", "prefix1", "prefix2")
    distinct = whole.groupBy("position", "prefix1", "prefix2").agg(F.min("conv.conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = hashed.where("position < n_turns").select("position", "prefix1", "prefix2").distinct()
    kept = distinct.join(prefixes, ["position", "prefix1", "prefix2"], "left_anti")
    return kept.select(F.struct("conv_id").alias("conv"), "copies")


def segments(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn of each maximal conversation.

    Columns: conv_id, position, n_turns, copies, role, segment (the rendered turn) and
    trained (whether a model learns to write it: assistants' turns).
    """
    columns = {"id_col": id_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    hashed = checkpointed(turn_hashes(turns, **columns))
    kept = hashed.join(maximal(hashed), "conv").select("key", "position", "n_turns", "copies")
    texts = _plain(turns, **columns).groupBy("key").agg(F.first("text").alias("text"))
    rows = kept.join(texts, "key").select("key.conv_id", "key.role", "position", "n_turns", "copies", "text")
    segment = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    return rows.select("conv_id", "position", "n_turns", "copies", "role", segment.alias("segment"), (F.col("role") == "assistant").alias("trained"))


def documents(rendered: DataFrame) -> DataFrame:
    """(conv_id, text): the segments of each conversation in order, as one text.

    For conversations that fit in memory one at a time.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "segment")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["segment"]), "").alias("text"))
