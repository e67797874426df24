"""Edges: asserted ties between mentions become one scored statement for each pair and type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import rounded
from .dedupe import active

DECAY_A_YEAR = 0.15
DAYS_A_YEAR = 365
LONG_TIE_YEARS = 5
#: Money at which an amount adds no more strength.
FULL_MONEY = 1_000_000


@dataclass(frozen=True)
class Raw:
    """The immutable layer: assertions between mentions, what mentions resolve to, entities."""

    assertions: DataFrame
    resolutions: DataFrame
    entities: DataFrame


def mapped(raw: Raw) -> DataFrame:
    """Assertions between resolved entities, with their confidence; no self-loops."""
    priors = F.broadcast(schemas.sources(raw.assertions.sparkSession))  # a fixed lookup table
    known = active(raw.resolutions)
    end = lambda which: known.select(
        F.col("mention_id").alias(f"{which}_mention_id"), F.col("entity_id").alias(f"{which}_id"), F.col("match_confidence").alias(f"{which}_confidence")
    )
    joined = raw.assertions.join(end("from"), "from_mention_id").join(end("to"), "to_mention_id").join(priors, "source_code")
    confidence = F.col("reliability_prior") * F.least("from_confidence", "to_confidence")
    return joined.where("from_id != to_id").select(
        "assertion_id", F.col("from_id").alias("subject_id"), "statement_type", F.col("to_id").alias("object_id"),
        "valid_from", "valid_to", "amount_gbp", "source_code", confidence.alias("confidence"),
    )


def strength(weight: Column, valid_from: Column, valid_to: Column, amount: Column, as_of: Column, with_money: bool = True) -> Column:
    """Type weight, faded since the tie ended, by its length and its money; four digits."""
    end = F.coalesce(valid_to, as_of)
    faded = F.exp(-DECAY_A_YEAR * F.greatest(F.lit(0), F.datediff(as_of, end)) / DAYS_A_YEAR)
    length = F.when(valid_from.isNull(), F.lit(0.5)).otherwise(1 - F.exp(-F.greatest(F.lit(0), F.datediff(end, valid_from)) / DAYS_A_YEAR / LONG_TIE_YEARS))
    money = F.when(amount.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.log(1 + amount.cast("double")) / F.log(F.lit(1.0 + FULL_MONEY))))
    whole = weight * faded * length * (money if with_money else F.lit(1.0))
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)), 4)


def statement_id() -> Column:
    return F.md5(F.concat_ws("|", "statement_type", "subject_id", "object_id"))


def collapse(assertions: DataFrame) -> DataFrame:
    """One row for each (subject, type, object): dates, best confidence and amount, sources."""
    return assertions.groupBy("subject_id", "statement_type", "object_id").agg(
        F.min("valid_from").alias("valid_from"),
        F.when(F.bool_or(F.col("valid_to").isNull()), F.lit(None)).otherwise(F.max("valid_to")).alias("valid_to"),
        F.max("confidence").alias("confidence"),
        F.max("amount_gbp").alias("amount_gbp"),
        F.sort_array(F.collect_set("source_code")).alias("sources"),
    )


def statements(raw: Raw, as_of: str, with_money: bool = True) -> DataFrame:
    """All scored statements as of a date; ``with_money=False`` leaves amounts out of strength."""
    types = F.broadcast(schemas.statement_types(raw.assertions.sparkSession).select("statement_type", "type_weight"))
    edges = collapse(mapped(raw)).join(types, "statement_type")
    scored = strength(F.col("type_weight"), F.col("valid_from"), F.col("valid_to"), F.col("amount_gbp"), F.lit(as_of).cast("date"), with_money)
    return edges.select(
        statement_id().alias("statement_id"), "subject_id", "statement_type", "object_id", "valid_from", "valid_to",
        rounded(F.col("confidence"), 4).alias("confidence"), scored.alias("strength"), "amount_gbp", "sources",
    )


def provenance(raw: Raw) -> DataFrame:
    """(statement_id, assertion_id) pairs, each once, of the assertions that statements are made of.

    Assertions are mapped once; only the known types make statements.
    """
    known = F.col("statement_type").isin(*schemas.STATEMENT_TYPES)
    return mapped(raw).where(known).select(statement_id().alias("statement_id"), "assertion_id").distinct()


def corroborated(raw: Raw) -> DataFrame:
    """Noisy-or confidence over independent sources, beside the maximum in ``statements``. An extra."""
    best = mapped(raw).groupBy("subject_id", "statement_type", "object_id", "source_code").agg(F.max("confidence").alias("c"))
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-12)))))
    return best.groupBy("subject_id", "statement_type", "object_id").agg(rounded(1 - doubt, 4).alias("confidence"), F.count("*").alias("n_sources"))
