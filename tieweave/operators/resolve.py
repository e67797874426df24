"""Deterministic resolution of mentions to entities, as one cascade of rules.

Each rule gives a mention a key or null; the first rule that gives a key wins, and one
aggregation over (rule, key) makes the entities, instead of a pass for each rule over
what the rules before it left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) != ""


def company_number_key() -> Column:
    """The company number, digits padded to eight places (longer ones are cut)."""
    number = F.col("company_number")
    padded = F.when(number.rlike("^[0-9]+$"), F.lpad(number, 8, "0")).otherwise(number)
    return F.when((F.col("entity_type_hint") == "company") & _filled("company_number"), padded)


def party_name_key() -> Column:
    """The party's name without a bracketed end, legal words, plural s and article."""
    plain = F.regexp_replace(F.lower("raw_name"), "\\s*\\([^)]*\\)\\s*$", "")
    plain = F.trim(F.regexp_replace(plain, "( and unionist| party|s$|^the )", ""))
    return F.when(F.col("entity_type_hint") == "party", plain)


def named_body_key() -> Column:
    return F.when(F.col("entity_type_hint").isin("organisation", "government_body", "appg"), F.lower(F.trim("raw_name")))


def rules() -> dict[str, Column]:
    """The key of each rule, in order of precedence."""
    return {
        "company_number": company_number_key(),
        "party_name": party_name_key(),
        "officer_link": F.when(_filled("officer_link"), F.col("officer_link")),
        "parliament_id": F.when(_filled("parliament_member_id"), F.col("parliament_member_id")),
        "body_name": F.when(_filled("donor_id") | _filled("regulated_entity_id"), F.lit(None)).otherwise(named_body_key()),
        "donor_id": F.when(_filled("donor_id"), F.col("donor_id")),
        "regulated_entity_id": F.when(_filled("regulated_entity_id"), F.col("regulated_entity_id")),
        "single": F.col("mention_id"),
    }


def keyed(mentions: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """``mentions`` with rule, key and entity_id; ``names`` picks rules (without one, a mention may stay null)."""
    own = rules()
    chosen = [F.when(own[n].isNotNull(), F.struct(F.lit(n).alias("rule"), own[n].alias("key"))) for n in names or own]
    found = mentions.withColumn("_r", F.coalesce(*chosen)).select(*mentions.columns, "_r.rule", "_r.key")
    return found.withColumn("entity_id", F.md5(F.concat_ws("|", "rule", "key")))


def entities(keyed_mentions: DataFrame) -> DataFrame:
    """(entity_id, rule, entity_type, name, category, n_mentions): one entity for each key."""
    corporate = F.bool_or(F.coalesce(F.lower("officer_role").startswith("corporate"), F.lit(False)) | F.coalesce("has_identification", F.lit(False)))
    hint = F.max(F.coalesce("entity_type_hint", F.lit("person")))
    grouped = keyed_mentions.where("rule is not null").groupBy("entity_id", "rule").agg(
        corporate.alias("corporate"), hint.alias("hint"), F.min("raw_name").alias("name"), F.count("*").alias("n_mentions")
    )
    rule = F.col("rule")
    kind = (
        F.when(rule == "company_number", "company").when(rule == "party_name", "party").when((rule == "officer_link") & F.col("corporate"), "organisation")
        .when(rule.isin("officer_link", "parliament_id"), "person").otherwise(F.col("hint"))
    )
    category = F.when(rule == "company_number", "company").when(rule == "party_name", "party").when(rule == "parliament_id", "mp")
    return grouped.select("entity_id", "rule", kind.alias("entity_type"), "name", category.alias("category"), "n_mentions")


#: What a mention says of itself, beside its name and source.
ATTRIBUTES = ("company_number", "officer_link", "officer_role", "parliament_member_id", "donor_id", "regulated_entity_id", "country", "nationality")


def singletons(keyed_mentions: DataFrame) -> DataFrame:
    """(mention_id, entity_id, entity_type, name, attributes) of mentions that no rule joins with others; they keep what they say."""
    own = keyed_mentions.where("rule = 'single'")
    said = F.map_from_arrays(F.array(*map(F.lit, ATTRIBUTES)), F.array(*(F.col(c).cast("string") for c in ATTRIBUTES)))
    there = F.map_filter(said, lambda k, v: v.isNotNull())
    return own.select("mention_id", "entity_id", F.coalesce("entity_type_hint", F.lit("person")).alias("entity_type"), F.col("raw_name").alias("name"), there.alias("attributes"))


def resolutions(keyed_mentions: DataFrame) -> DataFrame:
    """(mention_id, entity_id, match_confidence); every rule is certain."""
    return keyed_mentions.where("rule is not null").select("mention_id", "entity_id", F.lit(1.0).alias("match_confidence"))


def unresolved(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    return mentions.join(resolved.select("mention_id"), "mention_id", "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
