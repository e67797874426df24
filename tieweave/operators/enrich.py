"""Enrichment: the usual residence, nationality and jurisdiction of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_country


def modal(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with the most frequent value of each key; ties go to the first in order.

    ``mode`` has another rule for ties, so counts are ordered explicitly.
    """
    counts = values.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(value))


def residences(mentions: DataFrame) -> DataFrame:
    """(entity_id, country) of persons, from company registers; names of the home country are one."""
    own = mentions.where("source_code = 'companies_house' and entity_type_hint = 'person'")
    return modal(own.withColumn("country", folded_country(F.col("country"))), "entity_id", "country")


def nationalities(mentions: DataFrame) -> DataFrame:
    return modal(mentions.where("source_code = 'companies_house' and entity_type_hint = 'person'"), "entity_id", "nationality")


def company_jurisdictions(mentions: DataFrame) -> DataFrame:
    """(entity_id, country) of companies: GB if a mention has a company number, else the usual address country."""
    own = mentions.where("entity_type_hint = 'company'")
    numbered = own.where("company_number is not null").select("entity_id").distinct().withColumn("country", F.lit("GB"))
    other = modal(own.withColumn("country", folded_country(F.col("country"))), "entity_id", "country")
    return numbered.unionByName(other.join(numbered, "entity_id", "left_anti"))


def with_attributes(entities: DataFrame, values: DataFrame, name: str, value: str, attributes: str = "attributes") -> DataFrame:
    """``entities`` with one more attribute where ``values`` has it; null values add none."""
    joined = entities.join(values.select("entity_id", F.col(value).alias("_value")), "entity_id", "left")
    own = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(own, lambda k, v: k != name)
    added = F.when(F.col("_value").isNull(), own).otherwise(F.map_concat(rest, F.create_map(F.lit(name), "_value")))
    return joined.withColumn(attributes, added).drop("_value")
