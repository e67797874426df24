"""Registered queries over everything: all insights, and the whole build as it is published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, insights
from ..operators.findings import Graph
from ..operators.resolve import union_all
from ..sources import fixture, landing, sinks
from . import build


def slots_text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries("slots")), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")


def _rows() -> dict[str, tuple[str, Column, Column]]:
    """Of each built table its key, what it says, and its number."""
    text = lambda *c: F.concat_ws("|", *c)
    none, empty = F.lit(None), F.lit("")
    return {
        "entities": ("entity_id", text("entity_type", "name", "category", "jurisdiction"), none),
        "statements": ("statement_id", text("subject_id", "statement_type", "object_id", F.array_join("sources", ",")), F.col("strength")),
        "conflicts": ("entity_id", text("conflict_strength", "conflict_overlap"), F.col("conflict_flag").cast("int")),
        "replaced": ("entity_id", F.col("survivor"), none),
        "scrutiny": ("entity_id", empty, F.col("scrutiny")),
        "findings": ("finding_id", text("shape_code", F.array_join(F.array_sort("member_ids"), ","), slots_text()), F.col("surprise")),
        "suggested_pairs": ("pair_id", text("from_id", "to_id", "why"), F.col("surprise")),
        "overseas_leads": ("lead_id", text("donor_id", "officer_name", "recipient"), F.col("amount_gbp")),
        "insights": ("insight_id", text("kind", "entity_id", slots_text()), F.col("priority")),
        "register_stats": ("stat", F.col("detail"), F.col("value")),
    }


def queries(graph: Callable[[SparkSession, str], Graph], descriptions: Callable, words: Callable) -> dict[str, Callable]:
    def insights_all(s: SparkSession, d: str) -> DataFrame:
        """Every insight: the last two kinds only where no other is, nearness to findings of all shapes."""
        g = graph(s, d)
        return insights.insights(g, findings.findings(g)).select("insight_id", "entity_id", "kind", "priority", "rank", "cohort_size", slots_text().alias("slots"))

    def build_whole(s: SparkSession, d: str) -> DataFrame:
        """(built, key, says, number): all rows of the ten tables of a build with its merges, published and read again."""
        built = build.build(fixture.raw(s, d), fixture.AS_OF, descriptions(s, d), words(s, d))
        path = landing.landed_path(s, "build")
        build.write(built, path)
        shown = [
            sinks.read_build(s, path, name).select(F.lit(name).alias("built"), F.col(key).alias("key"), says.alias("says"), number.cast("double").alias("number"))
            for name, (key, says, number) in _rows().items()
        ]
        return union_all(shown)

    return {"insights_all": insights_all, "build_whole": build_whole}
