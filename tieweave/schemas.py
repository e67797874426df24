"""Schemas of the raw and derived layers, and the lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MENTIONS = (
    "mention_id string, source_code string, entity_type_hint string, raw_name string, company_number string, officer_link string, "
    "officer_role string, has_identification boolean, parliament_member_id string, donor_id string, regulated_entity_id string, "
    "country string, nationality string, description string, dob string"
)
ASSERTIONS = (
    "assertion_id string, statement_type string, source_code string, from_mention_id string, to_mention_id string, "
    "valid_from date, valid_to date, amount_gbp decimal(18,2)"
)
ENTITIES = "entity_id string, entity_type string, name string, category string, jurisdiction string"
RESOLUTIONS = "mention_id string, entity_id string, match_confidence double"
STATEMENTS = (
    "statement_id string, subject_id string, statement_type string, object_id string, valid_from date, valid_to date, "
    "confidence double, strength double, amount_gbp decimal(18,2), sources array<string>"
)
FINDINGS = (
    "finding_id string, shape_code string, member_ids array<string>, statement_ids array<string>, slots map<string,string>, rarity double, "
    "corroboration double, money double, shape_weight double, surprise double, min_confidence double, is_lead boolean"
)

# Reliability of each source.
SOURCE_PRIORS = {
    "companies_house": 0.97,
    "electoral_commission": 0.97,
    "parliament_interests": 0.95,
    "parliament": 0.97,
    "contracts_finder": 0.96,
    "lords_interests": 0.96,
    "appg": 0.95,
}
# Weight, conductance and whether directed, of each statement type.
STATEMENT_TYPES = {
    "DIRECTOR_OF": (0.70, 0.60, True),
    "PSC_OF": (0.85, 0.85, True),
    "OWNS": (0.80, 0.90, True),
    "SHARES_ADDRESS_WITH": (0.40, 0.20, False),
    "CO_DIRECTOR": (0.70, 0.40, False),
    "DONATED_TO": (0.70, 0.50, True),
    "MEMBER_OF": (0.60, 0.30, True),
    "CHAIR_OF": (0.75, 0.55, True),
    "SECRETARIAT_OF": (0.60, 0.45, True),
    "FUNDS": (0.60, 0.45, True),
    "HOSPITALITY_FROM": (0.30, 0.20, True),
    "ADVISER_TO": (0.55, 0.45, True),
    "MINISTERIAL_ROLE": (0.90, 0.70, True),
    "CONTRACTED_WITH": (0.70, 0.50, True),
    "FAMILY_OF": (0.95, 0.60, False),
    "CO_MENTION": (0.10, 0.05, False),
}
# Entity types by kind.
ENTITY_KINDS = {
    "person": "person",
    "company": "organisation",
    "organisation": "organisation",
    "party": "organisation",
    "government_body": "organisation",
    "appg": "organisation",
}
#: Types that never count as evidence of identity or of surprise.
HUB_TYPES = ("party", "government_body")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*SOURCE_PRIORS.items()], "source_code string, reliability_prior double")


def statement_types(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in STATEMENT_TYPES.items()]
    return spark.createDataFrame(rows, "statement_type string, type_weight double, conductance double, directed boolean")
