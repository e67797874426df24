"""Registered queries: lists, news, sentences, attributes, mentions of persons, and the built tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import text
from ..operators import attention, dedupe, edges, enrich, findings, insights, matcher, reads, resolve, sentences
from ..operators.edges import Raw
from ..operators.findings import Graph
from ..sources import fixture, landing, registers, sinks
from . import build

START, OTHER = "P7", "R2"


def shown(attributes: str = "attributes") -> Column:
    """A map as text, by its keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, dob) of persons: years, months of years, or nothing."""
    k = F.col("c_custkey")
    year = F.concat(F.lit("19"), (10 + k % 7).cast("string"))
    dob = F.when(k % 3 == 0, year).when(k % 3 == 1, F.concat(year, F.lit("-0"), (1 + k % 2).cast("string")))
    return fixture.table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), k.cast("string")).alias("entity_id"), dob.alias("dob"))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with attributes: a segment of some persons, a nation of others."""
    k = F.col("c_custkey")
    own = F.map_from_arrays(
        F.array(F.lit("segment"), F.lit("nation")), F.array(F.when(k % 2 == 0, F.col("c_mktsegment")), F.when(k % 3 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))))
    )
    told = fixture.table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), k.cast("string")).alias("entity_id"), F.map_filter(own, lambda k, v: v.isNotNull()).alias("attributes"))
    return fixture.entities(spark, sf_dir).join(told, "entity_id", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def person_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture.raw(spark, sf_dir)
    named = raw.resolutions.join(raw.entities.select("entity_id", "name"), "entity_id").join(births(spark, sf_dir), "entity_id", "left")
    mentions = named.select("mention_id", F.col("name").alias("raw_name"), F.split_part("mention_id", F.lit(":"), F.lit(1)).alias("source_code"), "dob")
    return checkpointed(matcher.person_mentions(mentions, raw.assertions, raw.resolutions, raw.entities))


def half_active(spark: SparkSession, sf_dir: str) -> Raw:
    """The raw layer with some resolutions out of force."""
    raw = fixture.raw(spark, sf_dir)
    marked = raw.resolutions.withColumn("is_active", F.when(F.col("entity_id").startswith("P"), F.length("entity_id") % 2 == 0))
    return replace(raw, resolutions=marked)


def queries(graph: Callable[[SparkSession, str], Graph], mentions: Callable[[SparkSession, str], DataFrame]) -> dict[str, Callable]:
    def found(*shapes: str) -> Callable:
        return lambda s, d: findings.findings(graph(s, d), *shapes)

    def merges(s: SparkSession, d: str) -> DataFrame:
        g = graph(s, d)
        comps = checkpointed(dedupe.components(dedupe.person_links(g.entities, g.statements)))
        weights = findings.both_ends(g.statements).groupBy("entity_id").agg(F.count("*").alias("n"))
        return checkpointed(dedupe.replacements(comps, dedupe.survivors(comps, weights)))

    def some_insights(s: SparkSession, d: str) -> DataFrame:
        return resolve.union_all([f(graph(s, d)) for f in (insights.rank_portfolio, insights.only_donor_contractor, insights.bridge)])

    def coverage(s: SparkSession, d: str) -> DataFrame:
        return registers.coverage(landing.articles(s, d))

    def extras(s: SparkSession, d: str) -> DataFrame:
        keys = dedupe.person_keys(graph(s, d).entities)
        leads = findings.overseas_places(graph(s, d), keys)
        offshore = registers.offshore_matches(landing.leaked(s, d), landing.own_companies(s, d))
        return reads.extras(coverage(s, d), offshore, leads)

    def links_unsourced(s: SparkSession, d: str) -> DataFrame:
        g = graph(s, d)
        none = F.array().cast("array<string>")
        bare = replace(g, statements=g.statements.withColumn("sources", F.when(F.col("statement_type") == "CONTRACTED_WITH", F.col("sources")).otherwise(none)))
        return reads.links(bare).select("statement_id", "method")

    def published(s: SparkSession, d: str) -> DataFrame:
        """Two builds, one after the other; readers see the second."""
        path = landing.landed_path(s, "builds")
        tables = {"entities": fixture.entities(s, d), "ties": fixture.ties(s, d).groupBy("statement_type").agg(F.count("*").alias("n"))}
        sinks.publish(tables, path, "first")
        sinks.publish(tables | {"ties": tables["ties"].where("n > 100")}, path, "second")
        return sinks.read_build(s, path, "ties").withColumn("build", F.lit(sinks.current_build(s, path)))

    def rebuilt(s: SparkSession, d: str) -> DataFrame:
        raw, _ = build.merged(fixture.raw(s, d), fixture.AS_OF)
        own = edges.statements(raw, fixture.AS_OF)
        return own.select("statement_id", "subject_id", "statement_type", "object_id", "confidence", "strength", "amount_gbp")

    def gold(s: SparkSession, d: str) -> DataFrame:
        return matcher.gold(person_mentions(s, d))

    return {
        "load_findings": lambda s, d: reads.listed(found("BIG_MONEY", "QUIET_PORTFOLIO", "SHARED_BENCH")(s, d)).select("finding_id", "shape_code", "surprise", "place"),
        "load_insights": lambda s, d: reads.insights_by_entity(some_insights(s, d)).select("insight_id", "entity_id", "kind", "priority", "place"),
        "load_extras": extras,
        "entity_by_id": lambda s, d: reads.by_id(graph(s, d).entities, "entity_id", START),
        "id_set_hash": lambda s, d: found("BIG_MONEY", "SHARED_BENCH")(s, d).select("finding_id", reads.set_hash(F.col("member_ids")).alias("hash")),
        "news_of_findings": lambda s, d: reads.news_of(found("BIG_MONEY")(s, d), coverage(s, d)),
        "news_chips": lambda s, d: reads.news_of(found("BIG_MONEY")(s, d), coverage(s, d), 2),
        "ledger_teaser": lambda s, d: reads.listed(found("BIG_MONEY")(s, d)).where("place <= 6").select("finding_id", "place"),
        "finding_pivots": lambda s, d: reads.pivot_entity(found("BIG_MONEY", "SHARED_BENCH", "FAMILY_DESK", "LOOP_CLOSED")(s, d), graph(s, d).entities),
        "search_suggestions": lambda s, d: reads.suggestions(found("BIG_MONEY", "SHARED_BENCH")(s, d), graph(s, d).entities),
        "find_parliamentarians": lambda s, d: reads.find_parliamentarians(graph(s, d), " Gear", 7),
        "edges_between": lambda s, d: reads.between(graph(s, d), OTHER, START).select("statement_id", "strength"),
        "constellation_links": lambda s, d: reads.constellation_links(graph(s, d), checkpointed(reads.constellation(graph(s, d), found("BIG_MONEY")(s, d)))),
        "graph_links_unsourced": links_unsourced,
        "finding_sentences": lambda s, d: sentences.finding_texts(found("BIG_MONEY", "SHARED_BENCH", "LOOP_CLOSED", "CROSSING", "OVERSEAS_MONEY", "FAMILY_DESK")(s, d)),
        "insight_sentences": lambda s, d: sentences.insight_texts(resolve.union_all([f(graph(s, d)) for f in (insights.rank_money_given, insights.rank_portfolio, insights.bridge, insights.only_crossing)])),
        "receipts": lambda s, d: reads.receipts(graph(s, d), "Ties", reads.strongest_money_tie(graph(s, d), START)),
        "dedupe_births": lambda s, d: dedupe.person_pairs((g := graph(s, d)).entities, g.statements, births(s, d)),
        "dedupe_repoint": lambda s, d: dedupe.repoint(fixture.raw(s, d).resolutions, "entity_id", merges(s, d)).select("mention_id", "entity_id"),
        "dedupe_fold": lambda s, d: dedupe.fold_attributes(attributed(s, d), merges(s, d)).select("entity_id", shown().alias("attributes")),
        "enrich_attributes": lambda s, d: enrich.with_attributes(attributed(s, d), births(s, d), "nation", "dob").select("entity_id", shown().alias("attributes")),
        "resolve_singleton_attributes": lambda s, d: resolve.singletons(resolve.keyed(mentions(s, d))).select("mention_id", "entity_id", "entity_type", "name", shown().alias("attributes")),
        "edges_active": lambda s, d: edges.mapped(half_active(s, d)).groupBy("statement_type").agg(F.count("*").alias("n")),
        "person_mentions": lambda s, d: person_mentions(s, d).select("entity_id", "group", "surname", F.array_join("forenames", " ").alias("forenames"), F.array_join("neighbours", ",").alias("neighbours"), "birth_year"),
        "gold_pairs": gold,
        "gold_report": lambda s, d: matcher.gold_report(person_mentions(s, d)),
        "calib_isotonic": lambda s, d: matcher.isotonic(_coarse(s, d)),
        "build_publish": published,
        "build_statements": rebuilt,
    }


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, label) with few different scores."""
    rows = fixture.table(spark, sf_dir, "events").where("value is not null")
    score = F.round(F.col("value") % 1, 2)
    return rows.select(score.alias("score"), (score > 0.35 + (F.col("event_id") % 5) / 10).cast("int").alias("label"))
