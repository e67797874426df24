"""Merging of entities that are one: equal name keys and shared neighbours, hubs apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import text
from ..schemas import HUB_TYPES
from .components import connected_components


def active(resolutions: DataFrame) -> DataFrame:
    """The resolutions in force: those without a mark, and those marked ``is_active``."""
    return resolutions.where(F.coalesce("is_active", F.lit(True))) if "is_active" in resolutions.columns else resolutions


def neighbours(entities: DataFrame, statements: DataFrame) -> DataFrame:
    """(entity_id, neighbour), either direction, each once; hubs are no neighbours."""
    ends = F.explode(F.array(F.struct(F.col("subject_id").alias("e"), F.col("object_id").alias("n")), F.struct(F.col("object_id").alias("e"), F.col("subject_id").alias("n"))))
    both = statements.where("subject_id != object_id").select(ends.alias("x")).select(F.col("x.e").alias("entity_id"), F.col("x.n").alias("neighbour")).distinct()
    hubs = entities.where(F.col("entity_type").isin(*HUB_TYPES)).select(F.col("entity_id").alias("neighbour"))
    return both.join(hubs, "neighbour", "left_anti").select("entity_id", "neighbour")


def person_keys(entities: DataFrame) -> DataFrame:
    return entities.where("entity_type = 'person'").select("entity_id", text.person_key(F.col("name")).alias("name_key"))


def organisation_keys(entities: DataFrame) -> DataFrame:
    return entities.where("entity_type in ('organisation', 'company')").select("entity_id", text.organisation_key(F.col("name")).alias("name_key"))


def _links(left: DataFrame, on: list[str]) -> DataFrame:
    """(a, b): each member of a group with the least of it, which joins all that the group's pairs join, a row for each member."""
    least = F.min("entity_id").over(Window.partitionBy(*on))
    return left.select(*on, "entity_id").withColumn("a", least).where("a != entity_id").select("a", F.col("entity_id").alias("b"))


def _person_groups(entities: DataFrame, statements: DataFrame, births: DataFrame | None) -> list[tuple[DataFrame, list[str]]]:
    """Persons with their name key and what makes two of one key the same: a neighbour, a birth, a year that is all that is known of some birth."""
    keys = person_keys(entities).where("name_key != ''")
    found = [(keys.join(neighbours(entities, statements), "entity_id"), ["name_key", "neighbour"])]
    if births is not None:
        known = births.where("dob is not null").select("entity_id", "dob")
        years = known.withColumn("dob", F.substring("dob", 1, 4))
        exact = years.join(known.where("length(dob) = 4").select("dob").distinct(), "dob", "left_semi")
        found += [(keys.join(known, "entity_id"), ["name_key", "dob"]), (keys.join(exact, "entity_id"), ["name_key", "dob"])]
    return found


def person_pairs(entities: DataFrame, statements: DataFrame, births: DataFrame | None = None) -> DataFrame:
    """(a, b) of one key that share a neighbour, or a birth where ``births`` (entity_id, dob) has it.

    The join is on key and mark (a neighbour, a birth) together, so a frequent name alone makes no
    pairs. A pair is made at the least mark that both have, so none is made twice and
    pairs are not shuffled to drop repeats. Marks that only one of a name has are left out first; each
    person's row then has all its other marks. Where persons are only to be joined, ``person_links``
    does it without a row for each pair.
    """
    groups = enumerate(_person_groups(entities, statements, births))
    marks = reduce(DataFrame.unionByName, (own.select("entity_id", on[0], F.concat(F.lit(f"{i}:"), on[1]).alias("mark")) for i, (own, on) in groups)).distinct()
    members = Window.partitionBy("name_key", "mark")
    met = checkpointed(marks.withColumn("n", F.count("*").over(members)).where("n > 1").drop("n"))
    all_of = met.groupBy("entity_id").agg(F.collect_list("mark").alias("marks"))
    side = lambda x: met.join(all_of, "entity_id").select("name_key", "mark", F.col("entity_id").alias(x), F.col("marks").alias(f"marks_{x}"))
    pairs = side("a").join(side("b"), ["name_key", "mark"]).where("a < b")
    return pairs.where(F.array_min(F.array_intersect("marks_a", "marks_b")) == F.col("mark")).select("a", "b")


def person_links(entities: DataFrame, statements: DataFrame, births: DataFrame | None = None) -> DataFrame:
    """(a, b): enough of ``person_pairs`` to join all that these join; rows grow with persons' neighbours, not with pairs."""
    return reduce(DataFrame.unionByName, (_links(*group) for group in _person_groups(entities, statements, births))).distinct()


def organisation_pairs(entities: DataFrame) -> DataFrame:
    """(first, other): each organisation with the least id of its key, which is enough to join all of a key."""
    keys = organisation_keys(entities).where("name_key != ''")
    first = keys.groupBy("name_key").agg(F.min("entity_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return keys.join(first, "name_key").where("entity_id != a").select("a", F.col("entity_id").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(entity_id, component): the least id that can be reached, to the fixed point."""
    return connected_components(pairs).select(F.col("node").alias("entity_id"), F.col("root").alias("component"))


def survivors(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(component, survivor): most resolutions first, then the least id. weights: (entity_id, n)."""
    known = found.join(weights, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = known.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("less"), "entity_id")).alias("best"))
    return best.select("component", F.col("best.entity_id").alias("survivor"))


def replacements(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(entity_id, survivor) of entities that merge into another."""
    return found.join(kept, "component").where("entity_id != survivor").select("entity_id", "survivor")


def repoint(df: DataFrame, column: str, losers: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by the survivor of each merged entity."""
    own = losers.select(F.col("entity_id").alias("_loser"), F.col("survivor").alias("_survivor"))
    joined = df.join(own, F.col(column) == F.col("_loser"), "left")
    return joined.withColumn(column, F.coalesce("_survivor", column)).drop("_loser", "_survivor")


def fold_attributes(entities: DataFrame, losers: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Survivors with the attributes of what merged into them: their own win, then the least id's."""
    lost = entities.join(losers, "entity_id").select("survivor", "entity_id", F.explode(attributes).alias("k", "v")).where("v is not null")
    first = lost.groupBy("survivor", "k").agg(F.min_by("v", "entity_id").alias("v"))
    folded = first.groupBy(F.col("survivor").alias("entity_id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_folded"))
    kept = entities.join(losers, "entity_id", "left_anti").join(folded, "entity_id", "left")
    own: Column = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    missing = F.map_filter(F.coalesce("_folded", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    return kept.withColumn(attributes, F.map_concat(own, missing)).drop("_folded")


def merge(entities: DataFrame, statements: DataFrame, weights: DataFrame, births: DataFrame | None = None) -> DataFrame:
    """(entity_id, survivor) of all merges among persons and organisations."""
    found = components(checkpointed(person_links(entities, statements, births).unionByName(organisation_pairs(entities))))
    return replacements(found, survivors(found, weights))
