"""Plain sentences for findings and insights, as columns over their slots.

A slot that is missing leaves its part of a sentence out, never a gap in it.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How parties are spoken of.
PARTY_PHRASES = {
    "Conservative": "the Conservatives",
    "Conservatives": "the Conservatives",
    "Conservative and Unionist Party": "the Conservatives",
    "Labour": "Labour",
    "Labour Party": "the Labour Party",
    "Liberal Democrat": "the Liberal Democrats",
    "Liberal Democrats": "the Liberal Democrats",
    "Green": "the Green Party",
    "Green Party": "the Green Party",
    "Reform UK": "Reform UK",
    "Scottish National Party": "the SNP",
    "SNP": "the SNP",
    "Plaid Cymru": "Plaid Cymru",
}
#: A text for sharing has so many characters at most, its headline never under LEAST_HEADLINE.
SHARED_CHARS, LEAST_HEADLINE = 200, 20


def slot(name: str) -> Column:
    return F.nullif(F.col("slots")[name], F.lit(""))


def gbp(name: str) -> Column:
    """A slot as whole pounds with separators, halves away from zero."""
    return F.format_number(F.round(slot(name).try_cast("decimal(28,6)"), 0), 0)


def count(name: str) -> Column:
    return slot(name).try_cast("bigint")


def said(*parts: Column | str) -> Column:
    """The parts in one text; null if one of them is."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.when(n == 1, one).otherwise(many or f"{one}s")


def party_phrase(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PARTY_PHRASES.items() for x in pair))
    spoken = F.when(name.rlike(r"(?i)\b(party|uk|democrats|conservatives|greens)\b"), said("the ", name)).otherwise(name)
    return F.coalesce(known[name], spoken, F.lit("the party"))


def truncated(text: Column, n: Column) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, F.lit(1), n - 1), F.lit("…"))).otherwise(text)


def _by(column: str, sentences: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for key, sentence in sentences.items():
        out = F.when(F.col(column) == key, F.coalesce(sentence, otherwise)).otherwise(out)
    return out


# The wording of the sentences below.
def headline() -> Column:
    """One sentence for what a finding shows; contracts are counted, their money is not told."""
    party, recipient = party_phrase(slot("party")), party_phrase(slot("recipient"))
    n = count("contract_count")
    held = F.coalesce(said(" It also holds ", n.cast("string"), " public ", plural(n, "contract"), "."), F.lit(""))
    gave = F.coalesce(said(slot("company"), " gave £", gbp("donation_gbp"), " to ", party, "."), said(slot("company"), " is a donor to ", party, "."))
    abroad = slot("jurisdiction")
    amount = gbp("amount_gbp")
    return _by(
        "shape_code",
        {
            "LOOP_CLOSED": said(gave, held),
            "SHARED_BENCH": said(slot("org"), " is tied to ", slot("n_people"), " parliamentarians."),
            "FAMILY_DESK": said(slot("person_a"), " and ", slot("person_b"), " are both tied to ", slot("company"), "."),
            "BIG_MONEY": F.coalesce(said(slot("donor"), " gave £", amount, " to ", recipient, "."), said(slot("donor"), " made a donation to ", recipient, ".")),
            "OVERSEAS_MONEY": F.coalesce(
                said("£", amount, " to ", recipient, " from a donor with a registered residence in ", abroad, "."),
                said("£", amount, " to ", recipient, " from a donor with an overseas registered residence."),
                said("A donation to ", recipient, " from a donor with a registered residence in ", F.coalesce(abroad, F.lit("an overseas jurisdiction")), "."),
            ),
            "CROSSING": said(slot("entity"), " appears in ", slot("n_registers"), " public registers."),
            "SECTOR_OVERLAP": F.coalesce(said(slot("mp"), " sits where their declared interests overlap with ", slot("overlap"), "."), said(slot("mp"), " sits where their declared interests overlap.")),
            "NEW_ON_REGISTER": said("New on the register: ", slot("subject"), " and ", slot("object"), "."),
        },
        F.lit("A sourced structural pattern in the public registers."),
    )


def why_line() -> Column:
    """One sentence on why a finding merits a look; the pattern alone, no verdict."""
    return _by(
        "shape_code",
        {
            "LOOP_CLOSED": F.lit("Money went to a party, and public contracts came to the same company. That two-way flow is why this merits a look."),
            "OVERSEAS_MONEY": F.lit("Donations linked to overseas residence face extra rules in the UK. The size and origin of this one make it worth a look."),
            "SHARED_BENCH": F.coalesce(
                said("One organisation tied to ", slot("n_people"), " lawmakers is a concentration worth knowing about."),
                F.lit("One organisation tied to several lawmakers is a concentration worth knowing about."),
            ),
            "FAMILY_DESK": F.lit("Two public figures sharing one company is worth a look."),
            "BIG_MONEY": F.coalesce(said("£", gbp("amount_gbp"), " is among the largest single donations in this register."), F.lit("This is among the largest single donations in this register.")),
            "CROSSING": F.coalesce(said("The same name appears in ", slot("n_registers"), " separate public registers."), F.lit("The same name appears in separate public registers.")),
            "SECTOR_OVERLAP": F.lit("A lawmaker sits where their declared interests overlap with their public role."),
            "NEW_ON_REGISTER": F.lit("This appeared on the register in the last 30 days."),
        },
        F.lit("A sourced structural pattern in the public registers, worth a look."),
    )


def share_text() -> Column:
    """The headline, cut where it must be, and how many registers it rests on."""
    n = count("n_registers")
    suffix = F.coalesce(said("Sourced from ", n.cast("string"), " public ", plural(n, "register"), ". "), F.lit("Sourced from the public registers. "))
    return said(truncated(headline(), F.greatest(F.lit(LEAST_HEADLINE), SHARED_CHARS - F.length(suffix))), " ", suffix)


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return said(n.cast("string"), end)


def insight_sentence() -> Column:
    """One sentence for an insight: kind, slots and rank."""
    total, n, rank = gbp("total_gbp"), count("n_donations"), F.col("rank")
    ties, registers, hops = count("n_ties"), count("n_registers"), count("hops")
    percentile = slot("percentile").try_cast("double")
    noun = F.coalesce(F.regexp_replace(slot("cohort"), r"(?i)^the\s+", ""), F.lit("entities in this register"))
    across = F.coalesce(said(" across ", n.cast("string"), " ", plural(n, "donation")), F.lit(""))
    most = F.when(rank <= 3, said(", the ", ordinal(rank), " most in this register")).otherwise("")
    step = said(hops.cast("string"), " ", plural(hops, "step"))
    basic = F.coalesce(
        said(ties.cast("string"), " sourced ", plural(ties, "connection"), " across ", registers.cast("string"), " ", plural(registers, "register"), "."),
        said(ties.cast("string"), " sourced ", plural(ties, "connection"), "."),
        F.lit("A sourced entity in the public registers."),
    )
    return _by(
        "kind",
        {
            "RANK_MONEY_GIVEN": F.coalesce(
                F.when(rank <= 3, said("The ", ordinal(rank), " largest donor in this register: £", total, across, ".")),
                said("Gave £", total, " in declared political donations."), F.lit("Made declared political donations."),
            ),
            "RANK_MONEY_RECEIVED": F.coalesce(said("Received £", total, " in declared donations", F.coalesce(most, F.lit("")), "."), F.lit("Received declared political donations.")),
            "RANK_PORTFOLIO": F.coalesce(
                F.when(percentile >= 75, said("More declared corporate ties than ", F.floor(percentile + 0.5).cast("string"), "% of ", noun, ": ", ties.cast("string"), " in the registers.")),
                said(ties.cast("string"), " declared corporate ", plural(ties, "tie"), " in the registers."), F.lit("Has declared corporate ties in the registers."),
            ),
            "ONLY_N": F.coalesce(said("One of ", slot("set_size"), " entities with this pattern."), F.lit("A rare pattern in this register.")),
            "BRIDGE": F.coalesce(
                said("Appears in ", registers.cast("string"), " public ", plural(registers, "register"), ": the widest crossings in the data."), F.lit("Appears across multiple public registers.")
            ),
            "NEAREST_NOTABLE": F.coalesce(
                said(step, " from ", slot("notable_name"), " in the register graph."), said("Close to ", slot("notable_name"), " in the register graph."), F.lit("Connected within the register graph.")
            ),
        },
        basic,
    )


def finding_texts(found: DataFrame) -> DataFrame:
    """(finding_id, headline, why, share)."""
    return found.select("finding_id", headline().alias("headline"), why_line().alias("why"), share_text().alias("share"))


def insight_texts(df: DataFrame) -> DataFrame:
    """(insight_id, sentence, cohort)."""
    return df.select("insight_id", insight_sentence().alias("sentence"), F.coalesce(slot("cohort"), F.lit("")).alias("cohort"))


