"""Registered queries over the readers of landed registers and over the writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import attention, findings, insights
from ..operators.findings import Graph
from ..sources import landing, registers, sinks
from ..sources.fixture import names, table
from ..sources.registers import Landed

_KEYS = "company_number officer_link officer_role parliament_member_id donor_id regulated_entity_id country nationality description dob".split()


def rows(landed: Landed) -> DataFrame:
    """Mentions and ties of a reader as rows of one form: record, id, source_code, kind, name, detail."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mentions = landed.mentions.select(
        F.lit("mention").alias("record"), F.col("mention_id").alias("id"), "source_code", F.col("entity_type_hint").alias("kind"), F.col("raw_name").alias("name"),
        F.concat_ws("|", *map(filled, _KEYS), filled("has_identification")).alias("detail"),
    )
    ties = landed.assertions.select(
        F.lit("tie").alias("record"), F.col("assertion_id").alias("id"), "source_code", F.col("statement_type").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.concat_ws("|", *map(filled, ("from_mention_id", "to_mention_id", "valid_from", "valid_to", "amount_gbp"))).alias("detail"),
    )
    return mentions.unionByName(ties)


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(officer, name, company_number, active) of the landed companies."""
    own = landing.companies(spark, sf_dir).select("company_number", "company_status", F.explode("officers").alias("o"))
    active = (F.col("company_status") == "active") & F.col("o.resigned_on").isNull()
    return own.select(F.col("o.link").alias("officer"), F.col("o.name").alias("name"), "company_number", active.alias("active")).distinct()


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.crawl(landing.companies(spark, sf_dir), appointments(spark, sf_dir), "00000001", 5)


def bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "supplier").selectExpr("if(s_suppkey % 6 = 0, 'The Company', concat(s_name, if(s_suppkey % 2 = 0, ' Ltd', ''))) name").distinct()
    known = landing.contract_names(spark, sf_dir).selectExpr("company_number", "name company_name", "if(company_number like '%5', 'dissolved', 'Active') company_status")
    return registers.bridge(declared, known)


def donor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = registers.donations(landing.donations(spark, sf_dir))
    return registers.donor_groups(landed.mentions, landed.assertions)


def news_names(graph: Callable[[SparkSession, str], Graph]) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        keys = g.entities.where("entity_type = 'person'").select("entity_id", text.person_key(F.col("name")).alias("name_key"))
        return registers.news_names(findings.findings(g, "CROSSING"), insights.rank_portfolio(g), findings.overseas_donors(g, keys), g.entities, most=120)

    return query


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_code, k, v): a small table to write."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderstatus source_code", "o_orderkey k", "cast(floor(o_totalprice) as bigint) v")


def written_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two loads, then one source loaded again with other values."""
    path, own = landing.landed_path(spark, "numbers"), _numbers(spark, sf_dir)
    sinks.append(own.where("k % 2 = 0"), path)
    sinks.append(own.where("k % 2 = 1"), path)
    sinks.replace_source(own.where("source_code = 'F' and k % 3 = 0").withColumn("v", F.lit(1).cast("long")), path)
    return spark.read.parquet(path).select("source_code", "k", "v")


def written_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, own = landing.landed_path(spark, "derived"), _numbers(spark, sf_dir)
    sinks.rebuild(own, path)
    sinks.rebuild(own.where("k % 5 = 0"), path)
    return spark.read.parquet(path).select("source_code", "k", "v")


def written_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the raw layer after a reset of one source; the derived layer is gone."""
    raw, derived = landing.landed_path(spark, "raw"), landing.landed_path(spark, "derived")
    sinks.append(_numbers(spark, sf_dir), raw)
    sinks.rebuild(_numbers(spark, sf_dir), derived)
    sinks.reset(spark, raw, derived, ("P", "not there"))
    left = 0 if sinks.read_path(spark, derived) is None else 1
    return spark.read.parquet(raw).select("source_code", "k", F.lit(left).alias("derived_left"))


def written_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, own = landing.landed_path(spark, "seeds"), _numbers(spark, sf_dir)
    sinks.insert_absent(own.where("k % 4 = 0"), path, ["k"])
    sinks.insert_absent(own.where("k % 2 = 0").withColumn("v", -F.col("v")), path, ["k"])
    return spark.read.parquet(path).select("source_code", "k", "v")


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _numbers(spark, sf_dir)
    return sinks.update(own, own.where("k % 7 = 0").select("k", F.when(F.col("k") % 2 == 0, F.lit(0)).cast("long").alias("v")), "k", ["v"])


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _numbers(spark, sf_dir)
    return sinks.delete(own, own.where("v % 3 = 0"), "k")


def optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a table that isn't there gives no rows of the wanted columns."""
    missing = sinks.read_if_there(spark, "no_such_table_of_ours", "lead_id string, name string")
    return missing.unionByName(table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as string) lead_id", "r_name name"))


def themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of texts that have one of the lexicon's words each, chosen by the part's number."""
    words = [w for own in attention.THEMES.values() for w in own]
    part = table(spark, sf_dir, "part").withColumn("word", F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int")))
    texts = part.select("p_partkey", F.concat(F.lit("supplies "), "word", F.lit("s and "), "p_name").alias("text"))
    return attention.themes_of(texts, "p_partkey", "text", attention.LEXICON)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of declared organisations, by their names as ids."""
    landed = registers.interests(landing.interests(spark, sf_dir))
    own = landed.mentions.withColumn("entity_id", F.lower("raw_name"))
    return attention.descriptions(own)


def offshore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.offshore_matches(landing.leaked(spark, sf_dir), landing.own_companies(spark, sf_dir))


def queries(graph: Callable[[SparkSession, str], Graph]) -> dict[str, Callable]:
    return {
        "land_companies": lambda s, d: rows(registers.companies(landing.companies(s, d))),
        "land_donations": lambda s, d: rows(registers.donations(landing.donations(s, d))),
        "land_members": lambda s, d: rows(registers.members(landing.members(s, d))),
        "land_interests": lambda s, d: rows(registers.interests(landing.interests(s, d))),
        "land_lords": lambda s, d: rows(registers.lords(landing.lords(s, d))),
        "land_contracts": lambda s, d: rows(registers.contracts(landing.awards(s, d), landing.contract_names(s, d))),
        "land_groups": lambda s, d: rows(registers.groups_html(landing.group_pages(s, d))),
        "land_group_cells": lambda s, d: registers.html_rows(landing.group_pages(s, d)).where("table = 0").select("page_id", "row", F.array_join("cells", "|").alias("cells")),
        "land_group_index": lambda s, d: registers.group_index(registers.latest_edition(landing.group_contents(s, d), registers.group_editions("2001-08-01")).withColumnsRenamed({"edition": "page_id", "body": "html"})),
        "land_articles": lambda s, d: registers.articles_found(landing.answers(s, d)),
        "land_leaked": lambda s, d: landing.leaked(s, d),
        "largest_donations": lambda s, d: registers.largest_donations(landing.donations(s, d), 25).select("ECRef", "Value"),
        "crawl_companies": crawled,
        "contract_targets": lambda s, d: registers.contract_targets(landing.own_companies(s, d), names(s, d).companies.selectExpr("concat('C', id) entity_id", "if(id % 3 = 0, ' ', cast(id as string)) company_number")),
        "offshore_leads": offshore,
        "news_coverage": lambda s, d: registers.coverage(landing.articles(s, d)),
        "news_names": news_names(graph),
        "declared_companies": lambda s, d: registers.declared_companies((x := registers.interests(landing.interests(s, d))).mentions, x.assertions),
        "bridge_companies": bridged,
        "not_ingested": lambda s, d: registers.not_ingested(
            landing.companies(s, d).select("company_number"), names(s, d).companies.where("id % 3 = 0").selectExpr("concat(lpad(cast(id as string), 8, '0'), ':officers') external_ref")
        ),
        "donor_groups": donor_groups,
        "donor_appointments": lambda s, d: registers.donor_appointments(donor_groups(s, d), appointments(s, d)),
        "write_by_source": written_by_source,
        "write_rebuild": written_rebuilt,
        "write_reset": written_reset,
        "write_insert_absent": written_absent,
        "write_update": updated,
        "write_delete": deleted,
        "scan_optional": optional,
        "theme_lexicon": themed,
        "company_descriptions": described,
    }
