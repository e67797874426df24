"""Ranks, places and running sums over whole tables, without a task that holds them all.

Rows are dealt out by ranges of the order, so each partition is a run of it. What comes
before a partition is a sum over the partitions before it, a table with one row for each
partition (and cohort), which alone is windowed as a whole and broadcast. Within a
partition, windows give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def _dealt(df: DataFrame, order: list[Column], cohort: str | None, sums: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """``df`` dealt out in order, with ``_before_<name>`` and ``_all_<name>`` for each of ``sums``, and the keys of a run.

    Written before it is dealt out, as ranges are found by reading it once more, and before its
    partitions are counted, so that both see the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = [F.col(cohort)] if cohort else []
    dealt = checkpointed(checkpointed(df).repartitionByRange(n, *first, *order).withColumn("_part", F.spark_partition_id()))
    keys = [*([cohort] if cohort else []), "_part"]
    whole = Window.partitionBy(*keys[:-1])
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.groupBy(*keys).agg(*(F.sum(c).alias(s) for s, c in sums.items()))
    before = own.select(
        *keys, *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums), *(F.sum(s).over(whole).alias(f"_all_{s}") for s in sums)
    )
    if cohort:
        same = before.withColumnsRenamed({k: f"_k{k}" for k in keys})
        return dealt.join(F.broadcast(same), [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys]).drop(*(f"_k{k}" for k in keys)), keys
    return dealt.join(F.broadcast(before), keys), keys


def ranked(df: DataFrame, by: str, cohort: str | None = None) -> DataFrame:
    """``df`` with rank (equal values share the first of their places), largest ``by`` first, and cohort_size.

    ``cohort`` has few values. Rows with one value of ``by`` lie in one partition.
    """
    dealt, keys = _dealt(df, [F.desc(by)], cohort, {"n": F.lit(1)})
    own = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return dealt.withColumn("rank", F.col("_before_n") + own).withColumn("cohort_size", F.col("_all_n")).drop("_part", "_before_n", "_all_n")


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with its places from 1 on, and ``n_places``; ``order`` should tell all rows apart."""
    dealt, keys = _dealt(df, list(order), None, {"n": F.lit(1)})
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return dealt.withColumn(name, F.col("_before_n") + own).withColumn("n_places", F.col("_all_n")).drop("_part", "_before_n", "_all_n")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums over the rows before each in ``order``, under the names of ``sums``."""
    dealt, keys = _dealt(df, order, None, sums)
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for name, column in sums.items():
        dealt = dealt.withColumn(f"_own_{name}", F.col(f"_before_{name}") + F.coalesce(F.sum(column).over(earlier), F.lit(0)))
    out = dealt.drop("_part", *(f"_{k}_{s}" for k in ("before", "all") for s in sums))
    return out.withColumnsRenamed({f"_own_{s}": s for s in sums})
