"""Registered queries over candidate pairs: names by several keys, and vectors by hyperplane keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators import blocking, neighbours
from ..sources import fixture


def name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.members(fixture.spelled(spark, sf_dir).select("mention_id", "raw_name", "birth_year"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = checkpointed(blocking.forms(name_members(spark, sf_dir)))
    return blocking.verified(blocking.candidates(form, dated=True)).drop("birth_year_a", "birth_year_b")


def name_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the keys on persons whom another register misspells."""
    member = checkpointed(name_members(spark, sf_dir))
    own = fixture.spelled(spark, sf_dir)
    left = own.where("mention_id like 'a:%'").select("person_id", F.col("mention_id").alias("left_id"))
    right = own.where("mention_id like 'b:%'").select("person_id", F.col("mention_id").alias("right_id"))
    return blocking.recall(left.join(right, "person_id"), member, blocking.candidates(checkpointed(blocking.forms(member))))


def vector_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(neighbours.units(fixture.table(spark, sf_dir, "embeddings")))


def asked(spark: SparkSession, sf_dir: str, unit: DataFrame) -> DataFrame:
    """The classes of the rows whose id is divisible by 20."""
    rows = neighbours.classes(fixture.table(spark, sf_dir, "embeddings")).where("row_id % 20 = 0")
    return unit.join(rows.select("class_id").distinct(), "class_id", "left_semi")


def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vector_units(spark, sf_dir)
    return neighbours.nearest(asked(spark, sf_dir, unit), unit)


def vector_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vector_units(spark, sf_dir)
    return neighbours.exact(asked(spark, sf_dir, unit), unit)


def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vector_units(spark, sf_dir)
    own = checkpointed(asked(spark, sf_dir, unit))
    return neighbours.recall(neighbours.nearest(own, unit), neighbours.exact(own, unit))


def queries() -> dict[str, Callable]:
    return {
        "block_name_members": lambda s, d: name_members(s, d).select("mention_id", "form_id"),
        "block_name_pairs": name_pairs,
        "block_name_recall": name_recall,
        "block_vector_classes": lambda s, d: neighbours.classes(fixture.table(s, d, "embeddings")),
        "block_vector_neighbours": vector_neighbours,
        "block_vector_exact": vector_exact,
        "block_vector_recall": vector_recall,
    }
