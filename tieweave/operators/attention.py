"""Scores of entities: money around them, and conflicts of office and interest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.text import rounded

FULL_MONEY = 5_000_000
OFFICE_BONUS = 0.2
CONTROL = ("DIRECTOR_OF", "PSC_OF", "OWNS", "CO_DIRECTOR")
SEATS = ("MEMBER_OF", "CHAIR_OF", "MINISTERIAL_ROLE")
INTERESTS = ("OWNS", "DIRECTOR_OF")

# Themes and the words that show them, in names and descriptions.
THEMES = {
    "housing": "home housing propert estate renter planning infrastructure construction tenant land architect planner".split() + ["real estate"],
    "finance": "capital invest financ bank asset fund trading advisory account equity wealth payment".split(),
    "health": "health care medical nhs pharma clinic hospital optic ophthalm optom".split(),
    "defence": ["defence", "military", "armed forces", "aerospace"],
    "data_tech": "data digital software online telecom cyber learning technolog".split(),
    "media": "media broadcast film music event festival culture sport entertain communicat".split() + ["public relations"],
    "transport": "transport rail aviation logistic freight".split(),
    "energy": "energy power renewable solar petroleum".split(),
    "education": "education school academ universit".split(),
    "legal": "litigation solicitor barrister chambers".split(),
    "procurement": ["procurement", "supply chain"],
}
# Internal committees, which are no remit.
INTERNAL_BODY = (
    "(commons commission|finance and services|finance committee|members estimate|administration estimate|audit and risk|standards|privileges|"
    "procedure committee|panel of chairs|committee of selection|backbench|liaison committee|restoration and renewal)"
)
# Interests that are party work.
PARTY_WORK = (
    "(labour|conservative|liberal democrat|reform uk|political organisation|political campaign|campaign support|deliver campaigns|"
    "support my work as an mp| party| to win)"
)


def money_credited(statements: DataFrame) -> DataFrame:
    """(entity_id, money): the largest donation given, got, given by what one controls, or got by what one belongs to."""
    gifts = statements.where("statement_type = 'DONATED_TO' and amount_gbp is not null")
    given = gifts.groupBy(F.col("subject_id").alias("entity_id")).agg(F.max("amount_gbp").alias("money"))
    got = gifts.groupBy(F.col("object_id").alias("entity_id")).agg(F.max("amount_gbp").alias("money"))

    def through(kinds: tuple[str, ...], side: DataFrame) -> DataFrame:
        ties = statements.where(F.col("statement_type").isin(*kinds)).select("subject_id", "object_id")
        reached = ties.join(side, F.col("object_id") == F.col("entity_id"))
        return reached.groupBy("subject_id").agg(F.max("money").alias("money")).withColumnRenamed("subject_id", "entity_id")

    every = given.unionByName(got).unionByName(through(CONTROL, given)).unionByName(through(("MEMBER_OF",), got))
    return every.groupBy("entity_id").agg(F.max("money").alias("money"))


def scrutiny(entities: DataFrame, statements: DataFrame) -> DataFrame:
    """(entity_id, money, scrutiny) for every entity; scrutiny from 0 to 1, three digits."""
    joined = entities.join(money_credited(statements), "entity_id", "left")
    office = F.coalesce(F.col("category") == "mp", F.lit(False)) & F.col("money").isNotNull()
    raw = F.coalesce(F.log(1 + F.col("money").cast("double")) / F.log(F.lit(1.0 + FULL_MONEY)), F.lit(0.0)) + F.when(office, OFFICE_BONUS).otherwise(0.0)
    return joined.select("entity_id", "money", rounded(F.least(F.lit(1.0), raw), 3).alias("scrutiny"))


#: (theme, word) pairs.
LEXICON = [(theme, word) for theme, words in THEMES.items() for word in words]


def descriptions(mentions: DataFrame) -> DataFrame:
    """(entity_id, description): the different descriptions of an entity's mentions, in lower case.

    mentions: (entity_id, description). A mention says a sentence or two; different ones of an entity are few.
    """
    own = mentions.select("entity_id", F.nullif(F.trim("description"), F.lit("")).alias("d")).where("d is not null").distinct()
    return own.groupBy("entity_id").agg(F.lower(F.array_join(F.sort_array(F.collect_list("d")), " ")).alias("description"))


def seats(entities: DataFrame, statements: DataFrame) -> DataFrame:
    """(mp_id, statement_id, org_id, name, confidence): offices of parliamentarians in outward bodies."""
    mps = entities.where("category = 'mp'").select(F.col("entity_id").alias("mp_id"))
    bodies = entities.where(F.col("entity_type").isin("organisation", "government_body") & ~F.lower("name").rlike(INTERNAL_BODY))
    held = statements.where(F.col("statement_type").isin(*SEATS)).select("statement_id", F.col("subject_id").alias("mp_id"), F.col("object_id").alias("org_id"), "confidence")
    return held.join(mps, "mp_id", "left_semi").join(bodies.select(F.col("entity_id").alias("org_id"), F.lower("name").alias("name")), "org_id")


def interests(entities: DataFrame, statements: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(mp_id, surname, org_id, org, text): what parliamentarians direct or own.

    descriptions: (entity_id, description) of what entities do.
    """
    mps = entities.where("category = 'mp'").select(F.col("entity_id").alias("mp_id"), F.regexp_replace(F.lower("name"), "^.* ", "").alias("surname"))
    held = statements.where(F.col("statement_type").isin(*INTERESTS)).select(F.col("subject_id").alias("mp_id"), F.col("object_id").alias("org_id"))
    orgs = entities.join(descriptions, "entity_id", "left").select(F.col("entity_id").alias("org_id"), F.col("name").alias("org"), "description")
    text = F.concat(F.lower("org"), F.lit(" "), F.coalesce("description", F.lit("")))
    return held.join(mps, "mp_id").join(orgs, "org_id").select("mp_id", "surname", "org_id", "org", text.alias("text"))


def themes_of(texts: DataFrame, key: str, text: str, words: list[tuple[str, str]]) -> DataFrame:
    """(key, theme) pairs: a word of the theme stands anywhere in the text.

    ``words`` is a lexicon of (theme, word), tested in one projection over the texts.
    """
    by: dict[str, list[str]] = {}
    for theme, word in words:
        by.setdefault(theme, []).append(word)
    if not by:
        return texts.select(key, F.lit(None).cast("string").alias("theme")).limit(0)
    any_of = lambda own: reduce(lambda a, b: a | b, (F.contains(F.col(text), F.lit(w)) for w in own))
    shown = F.array_compact(F.array(*(F.when(any_of(own), theme) for theme, own in by.items())))
    return texts.select(key, F.explode(shown).alias("theme")).distinct()


def conflicts(entities: DataFrame, statements: DataFrame, descriptions: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    """(entity_id, conflict_flag, conflict_strength, conflict_overlap, conflict_reason) for each parliamentarian."""
    # Each is read twice.
    seat, interest = written(seats(entities, statements)), written(interests(entities, statements, descriptions))
    both = themes_of(seat, "mp_id", "name", words).join(themes_of(interest, "mp_id", "text", words), ["mp_id", "theme"])
    overlap = both.groupBy("mp_id").agg(F.array_join(F.sort_array(F.collect_set("theme")), ", ").alias("overlap"))
    commercial = ~F.col("text").rlike(PARTY_WORK) & ~F.contains("text", F.lit("dormant")) & ~F.contains("text", "surname")
    held = interest.groupBy("mp_id").agg(
        F.array_join(F.sort_array(F.collect_set("org")), "; ").alias("orgs"), F.bool_or(commercial).alias("commercial")
    )
    sat = seat.groupBy("mp_id").agg(F.array_join(F.sort_array(F.collect_set("name")), "; ").alias("bodies"))
    mps = entities.where("category = 'mp'").select(F.col("entity_id").alias("mp_id"))
    joined = mps.join(held, "mp_id", "left").join(sat, "mp_id", "left").join(overlap, "mp_id", "left")
    flag = F.col("orgs").isNotNull() & F.col("bodies").isNotNull()
    level = F.when(F.col("overlap").isNotNull(), "strong").when(F.col("commercial"), "medium").otherwise("low")
    reason = F.concat(F.lit("Interests: "), "orgs", F.lit(". Seats: "), "bodies", F.lit(". "), F.coalesce(F.concat(F.lit("Shared themes: "), "overlap"), F.lit("No shared theme")))
    return joined.select(
        F.col("mp_id").alias("entity_id"), flag.alias("conflict_flag"), F.when(flag, level).alias("conflict_strength"),
        F.when(flag, F.col("overlap")).alias("conflict_overlap"), F.when(flag, reason).alias("conflict_reason"),
    )


def conflict_flags(entities: DataFrame, statements: DataFrame) -> DataFrame:
    """(entity_id, flagged, n_seats, n_interests): the plain motif, an office and an interest at one time."""
    own = statements.where(F.col("statement_type").isin(*SEATS, *INTERESTS)).groupBy(F.col("subject_id").alias("entity_id")).agg(
        F.count_distinct(F.when(F.col("statement_type").isin(*SEATS), F.col("object_id"))).alias("n_seats"),
        F.count_distinct(F.when(F.col("statement_type").isin(*INTERESTS), F.col("object_id"))).alias("n_interests"),
    )
    mps = entities.where("category = 'mp'").select("entity_id").join(own, "entity_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return mps.select("entity_id", count("n_seats"), count("n_interests")).withColumn("flagged", (F.col("n_seats") > 0) & (F.col("n_interests") > 0))
