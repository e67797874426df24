"""The whole build: raw layer in, every derived table out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..operators import attention, dedupe, edges, enrich, findings, insights, resolve
from ..operators.edges import Raw
from ..operators.findings import Graph
from ..sources import sinks


@dataclass(frozen=True)
class Build:
    """Derived tables of one build. ``graph`` is what reads work on."""

    graph: Graph
    replaced: DataFrame
    scrutiny: DataFrame
    findings: DataFrame
    suggested: DataFrame
    leads: DataFrame
    insights: DataFrame
    stats: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "entities": self.graph.entities, "statements": self.graph.statements, "conflicts": self.graph.conflicts, "replaced": self.replaced, "scrutiny": self.scrutiny,
            "findings": self.findings, "suggested_pairs": self.suggested, "overseas_leads": self.leads, "insights": self.insights, "register_stats": self.stats,
        }


def graph(raw: Raw, as_of: str, descriptions: DataFrame, words: list[tuple[str, str]]) -> Graph:
    """Entities and scored statements, written once, with the conflicts over them."""
    entities, statements = written(raw.entities), written(edges.statements(raw, as_of))
    return Graph(entities, statements, attention.conflicts(entities, statements, descriptions, words), as_of)


def merged(raw: Raw, as_of: str, births: DataFrame | None = None) -> tuple[Raw, DataFrame]:
    """The raw layer with duplicate entities replaced by their survivors, and the replacements.

    Survivors take over what only their duplicates say, if entities have ``attributes``.
    births: (entity_id, dob).
    """
    first = written(edges.statements(raw, as_of))
    weights = dedupe.active(raw.resolutions).groupBy("entity_id").agg(F.count("*").alias("n"))
    replaced = written(dedupe.merge(raw.entities, first, weights, births))
    if "attributes" in raw.entities.columns:
        entities = dedupe.fold_attributes(raw.entities, replaced)
    else:
        entities = raw.entities.join(replaced, "entity_id", "left_anti")
    return replace(raw, entities=entities, resolutions=dedupe.repoint(raw.resolutions, "entity_id", replaced)), replaced


def build(raw: Raw, as_of: str, descriptions: DataFrame, words: list[tuple[str, str]] | None = None, births: DataFrame | None = None) -> Build:
    """Dedupe, edges, scores, findings, insights and statistics as of a date. descriptions: of entities before the merge."""
    own, replaced = merged(raw, as_of, births)
    told = attention.descriptions(dedupe.repoint(descriptions, "entity_id", replaced))
    g = graph(own, as_of, told, attention.LEXICON if words is None else words)
    g = replace(g, conflicts=written(g.conflicts))
    found = written(findings.findings(g))
    keys = dedupe.person_keys(g.entities)
    return Build(
        g, replaced, attention.scrutiny(g.entities, g.statements), found, findings.suggested_pairs(g, found),
        findings.overseas_leads(g, keys), insights.insights(g, found), insights.register_stats(g),
    )


def resolved(mentions: DataFrame, assertions: DataFrame) -> tuple[Raw, DataFrame, DataFrame]:
    """(raw, descriptions, births) of landed mentions: resolved, with residence, nationality and jurisdiction.

    mentions: the columns of ``schemas.MENTIONS``.
    """
    keyed = written(resolve.keyed(mentions))
    entities = resolve.entities(keyed).withColumn("attributes", F.create_map().cast("map<string,string>"))
    entities = enrich.with_attributes(entities, enrich.nationalities(keyed), "nationality", "nationality")
    places = enrich.residences(keyed).unionByName(enrich.company_jurisdictions(keyed)).groupBy("entity_id").agg(F.min("country").alias("jurisdiction"))
    entities = enrich.with_attributes(entities.join(places, "entity_id", "left"), places, "jurisdiction", "jurisdiction")
    entities = entities.select("entity_id", "entity_type", "name", "category", "jurisdiction", "attributes")
    births = keyed.where("dob is not null").groupBy("entity_id").agg(F.min("dob").alias("dob"))
    return Raw(assertions, resolve.resolutions(keyed), entities), keyed.select("entity_id", "description"), births


def from_landed(mentions: DataFrame, assertions: DataFrame, as_of: str) -> Build:
    """The whole build from landed registers."""
    raw, descriptions, births = resolved(mentions, assertions)
    return build(replace(raw, entities=written(raw.entities)), as_of, descriptions, births=births)


def write(built: Build, path: str, build_id: str | None = None) -> str:
    """All derived tables below ``path``, seen by readers together or not at all; gives the build's id."""
    build_id = build_id or uuid.uuid4().hex
    sinks.publish(built.tables(), path, build_id)
    return build_id
