"""Findings: ranked structural patterns in the graph, all scored alike.

Each shape yields candidates (members, statements, slots, money, least confidence), and
``score`` turns all of them into findings in one pass: members and statements are
exploded, joined to what is known of each, and grouped again, so no shape has a scoring
query of its own and nothing is correlated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, written
from ..functions.text import rounded
from ..schemas import HUB_TYPES

FACT, GATE = 0.80, 0.50
#: Shares of the donors of a name; persons abroad of a name up to which they are one list.
SALTS, LISTED = 16, 100_000
WEIGHTS = {
    "LOOP_CLOSED": 1.0,
    "SHARED_BENCH": 0.8,
    "FAMILY_DESK": 0.9,
    "BIG_MONEY": 0.6,
    "OVERSEAS_MONEY": 0.95,
    "SECTOR_OVERLAP": 0.85,
    "QUIET_PORTFOLIO": 0.75,
    "CROSSING": 0.7,
    "NEW_ON_REGISTER": 0.5,
}
# Place names and other names that are no organisations.
NOISE_NAMES = "(?i)^(london|oxford|cambridge|edinburgh|cardiff|manchester|birmingham|glasgow|belfast|usa|uk|online|virtual|geneva|brussels)$"
NOISE_FORMS = "(?i)(university of|^the [a-z]+$)"
# Words that are no given names.
NO_GIVEN_NAMES = "mr mrs ms dr sir dame lord lady the rt hon honourable baroness baron earl of right".split()


@dataclass(frozen=True)
class Graph:
    """Entities, scored statements, conflicts of parliamentarians, and the date of the view."""

    entities: DataFrame
    statements: DataFrame
    conflicts: DataFrame
    as_of: str

    @property
    def hubs(self) -> DataFrame:
        return self.entities.where(F.col("entity_type").isin(*HUB_TYPES)).select("entity_id")

    def of(self, *types: str) -> DataFrame:
        return self.statements.where(F.col("statement_type").isin(*types))

    def named(self, prefix: str, *more: str) -> DataFrame:
        """Entities as (<prefix>_id, <prefix>, ...) for joins."""
        return self.entities.select(F.col("entity_id").alias(f"{prefix}_id"), F.col("name").alias(prefix), *(F.col(c).alias(f"{prefix}_{c}") for c in more))


def degree(graph: Graph) -> DataFrame:
    """(entity_id, degree): statements whose other end is no hub."""
    hub = graph.hubs
    s = graph.statements.select("subject_id", "object_id")
    out = s.join(hub, s.object_id == hub.entity_id, "left_anti").select(F.col("subject_id").alias("entity_id"))
    into = s.join(hub, s.subject_id == hub.entity_id, "left_anti").select(F.col("object_id").alias("entity_id"))
    return out.unionByName(into).groupBy("entity_id").agg(F.count("*").alias("degree"))


def idf(graph: Graph) -> DataFrame:
    """(entity_id, idf) for every entity: 1 / log2(2 + degree)."""
    known = graph.entities.join(degree(graph), "entity_id", "left")
    return known.select("entity_id", "entity_type", (1 / F.log2(2 + F.coalesce("degree", F.lit(0)))).alias("idf"))


def statement_sources(statements: DataFrame) -> DataFrame:
    return statements.select("statement_id", F.explode("sources").alias("source_code"))


def _slots(**values: Column | str) -> Column:
    """A map of texts; null values are left out."""
    pairs = [x for name, value in values.items() for x in (F.lit(name), (F.col(value) if isinstance(value, str) else value).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _candidate(df: DataFrame, shape: str, members: Column, statements: Column, slots: Column, money: Column | None, confidence: str) -> DataFrame:
    total = F.lit(None).cast("double") if money is None else money.cast("double")
    return df.select(
        F.lit(shape).alias("shape_code"), members.alias("member_ids"), statements.alias("statement_ids"), slots.alias("slots"),
        total.alias("total_gbp"), F.col(confidence).alias("min_confidence"),
    )


def loop_closed(g: Graph) -> DataFrame:
    """A donor to a party that also holds public contracts.

    Donations and contracts are first reduced to one row each for a company. The sum over
    contracts counts each once for every donation, as pairs of the two would.
    """
    parties = g.entities.where("entity_type = 'party'").select(F.col("entity_id").alias("object_id"), F.col("name").alias("party"))
    given = g.of("DONATED_TO").join(parties, "object_id").groupBy(F.col("subject_id").alias("company_id")).agg(
        F.collect_set("statement_id").alias("gifts"), F.max("amount_gbp").alias("top"), F.sum_distinct("amount_gbp").alias("given"),
        F.min("party").alias("party"), F.min("confidence").alias("given_confidence"), F.count("*").alias("n_gifts"),
    )
    won = g.of("CONTRACTED_WITH").groupBy(F.col("subject_id").alias("company_id")).agg(
        F.collect_set("statement_id").alias("contracts"), F.count("*").alias("n_contracts"), F.sum("amount_gbp").alias("won"), F.min("confidence").alias("won_confidence")
    )
    joined = given.join(won, "company_id").join(g.named("company"), "company_id")
    joined = joined.withColumn("won_total", F.col("won") * F.col("n_gifts")).withColumn("least", F.least("given_confidence", "won_confidence"))
    slots = _slots(company="company", party="party", donation_gbp="top", donation_total_gbp="given", contract_count="n_contracts", contract_total_gbp="won_total")
    money = F.coalesce(F.col("given").cast("double"), F.lit(0.0)) + F.coalesce(F.col("won_total").cast("double"), F.lit(0.0))
    return _candidate(joined, "LOOP_CLOSED", F.array("company_id"), F.array_union("gifts", "contracts"), slots, money, "least")


def shared_bench(g: Graph) -> DataFrame:
    """Three or more parliamentarians around one organisation."""
    noise = F.col("name").rlike(NOISE_NAMES) | F.col("name").rlike("^[0-9]") | F.col("name").rlike(NOISE_FORMS) | (F.length("name") < 4)
    orgs = g.entities.where(F.col("entity_type").isin("company", "organisation") & ~noise).select(F.col("entity_id").alias("object_id"), F.col("name").alias("org"))
    mps = g.entities.where("entity_type = 'person' and category = 'mp'").select(F.col("entity_id").alias("subject_id"), F.col("name").alias("person"))
    ties = g.of("ADVISER_TO", "DIRECTOR_OF", "CHAIR_OF", "SECRETARIAT_OF").join(orgs, "object_id").join(mps, "subject_id")
    bench = ties.groupBy("object_id", "org").agg(
        F.collect_set(F.struct("subject_id", "person")).alias("people"), F.collect_set("statement_id").alias("ids"), F.min("confidence").alias("least")
    ).where(F.size("people") >= 3)
    persons = F.transform("people", lambda x: x["subject_id"])
    names = F.array_join(F.array_sort(F.transform("people", lambda x: x["person"])), ", ")
    slots = _slots(org="org", n_people=F.size("people"), people=names)
    return _candidate(bench, "SHARED_BENCH", F.concat(F.array("object_id"), persons), F.col("ids"), slots, None, "least")


def surname(name: Column) -> Column:
    return F.lower(F.when(F.contains(name, F.lit(",")), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.regexp_replace(name, "^.* ", "")))


def given_tokens(name: Column) -> Column:
    """The different given-name words, null if there is none."""
    after = F.regexp_replace(F.split_part(name, F.lit(","), F.lit(2)), "^ ", "")
    given = F.when(F.contains(name, F.lit(",")), after).otherwise(F.regexp_replace(name, " [^ ]*$", ""))
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(given), "[^a-z ]", ""), " "))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*NO_GIVEN_NAMES))
    return F.when(F.size(kept) > 0, kept)


def family_desk(g: Graph) -> DataFrame:
    """Two persons of one surname around one company, with different given names.

    The join key is company and surname together, never the surname alone.
    """
    persons = g.entities.where("entity_type = 'person'").select(
        F.col("entity_id").alias("subject_id"), F.col("name").alias("person"), surname(F.col("name")).alias("surname"), given_tokens(F.col("name")).alias("given")
    ).where("length(surname) > 2 and given is not null")
    links = g.of("DIRECTOR_OF", "OWNS", "PSC_OF").join(persons, "subject_id")
    links = links.groupBy("object_id", "surname", "subject_id", "person", "given").agg(F.collect_set("statement_id").alias("ids"), F.min("confidence").alias("confidence"))
    a = links.select("object_id", "surname", *(F.col(c).alias(f"{c}_a") for c in ("subject_id", "person", "given", "ids", "confidence")))
    b = links.select("object_id", "surname", *(F.col(c).alias(f"{c}_b") for c in ("subject_id", "person", "given", "ids", "confidence")))
    apart = (F.size(F.array_except("given_a", "given_b")) > 0) & (F.size(F.array_except("given_b", "given_a")) > 0)
    pairs = a.join(b, ["object_id", "surname"]).where(F.col("subject_id_a") < F.col("subject_id_b")).where(apart)
    pairs = pairs.withColumn("least", F.least("confidence_a", "confidence_b")).join(g.named("company"), F.col("object_id") == F.col("company_id"))
    slots = _slots(company="company", surname="surname", person_a="person_a", person_b="person_b")
    return _candidate(pairs, "FAMILY_DESK", F.array("company_id", "subject_id_a", "subject_id_b"), F.array_union("ids_a", "ids_b"), slots, None, "least")


def _gifts(g: Graph) -> DataFrame:
    gifts = g.of("DONATED_TO").where("amount_gbp is not null").withColumnsRenamed({"subject_id": "donor_id", "object_id": "recipient_id"})
    return gifts.join(g.named("donor", "jurisdiction"), "donor_id").join(g.named("recipient"), "recipient_id")


def big_money(g: Graph) -> DataFrame:
    """Donations in the top tenth."""
    top = g.of("DONATED_TO").where("amount_gbp is not null").agg(F.percentile(F.col("amount_gbp").cast("double"), 0.9).alias("p90"))
    big = _gifts(g).crossJoin(F.broadcast(top)).where("cast(amount_gbp as double) >= p90")  # one row
    slots = _slots(donor="donor", recipient="recipient", amount_gbp="amount_gbp", donor_jurisdiction="donor_jurisdiction")
    return _candidate(big, "BIG_MONEY", F.array("donor_id", "recipient_id"), F.array("statement_id"), slots, F.col("amount_gbp"), "confidence")


def overseas_money(g: Graph) -> DataFrame:
    """Donations of donors who live abroad."""
    abroad = _gifts(g).where("donor_jurisdiction != 'GB'")
    slots = _slots(donor="donor", recipient="recipient", amount_gbp="amount_gbp", jurisdiction="donor_jurisdiction", basis=F.lit("Registered residence"))
    return _candidate(abroad, "OVERSEAS_MONEY", F.array("donor_id", "recipient_id"), F.array("statement_id"), slots, F.col("amount_gbp"), "confidence")


def sector_overlap(g: Graph) -> DataFrame:
    """A parliamentarian whose interests and offices conflict, strongly or by trade."""
    flagged = g.conflicts.where("conflict_flag and conflict_strength in ('strong', 'medium')").select(F.col("entity_id").alias("mp_id"), "conflict_strength", "conflict_overlap")
    sat = g.of("MEMBER_OF", "CHAIR_OF", "MINISTERIAL_ROLE").groupBy(F.col("subject_id").alias("mp_id")).agg(F.collect_set("statement_id").alias("seats"), F.min("confidence").alias("seat_confidence"))
    held = g.of("OWNS", "DIRECTOR_OF").groupBy(F.col("subject_id").alias("mp_id")).agg(
        F.collect_set("statement_id").alias("held"), F.collect_set("object_id").alias("orgs"), F.min("confidence").alias("held_confidence")
    )
    joined = flagged.join(sat, "mp_id").join(held, "mp_id").join(g.named("mp"), "mp_id").withColumn("least", F.least("seat_confidence", "held_confidence"))
    slots = _slots(mp="mp", strength="conflict_strength", overlap="conflict_overlap")
    return _candidate(joined, "SECTOR_OVERLAP", F.concat(F.array("mp_id"), "orgs"), F.array_union("seats", "held"), slots, None, "least")


def quiet_portfolio(g: Graph) -> DataFrame:
    """A person who directs or owns three companies or more."""
    persons = g.entities.where("entity_type = 'person'").select(F.col("entity_id").alias("subject_id"), F.col("name").alias("person"))
    roles = g.of("DIRECTOR_OF", "OWNS").join(persons, "subject_id").join(g.named("company"), F.col("object_id") == F.col("company_id"))
    held = roles.groupBy("subject_id", "person").agg(
        F.collect_set("statement_id").alias("ids"), F.collect_set(F.struct("company", "company_id")).alias("companies"), F.min("confidence").alias("least")
    ).where(F.size("companies") >= 3)
    names = F.array_join(F.transform(F.array_sort("companies"), lambda x: x["company"]), ", ")
    slots = _slots(person="person", n_companies=F.size("companies"), companies=names)
    return _candidate(held, "QUIET_PORTFOLIO", F.array("subject_id"), F.col("ids"), slots, None, "least")


def both_ends(statements: DataFrame, *columns: str) -> DataFrame:
    """(entity_id, ...) for either end of each statement."""
    own = [F.col(c) for c in columns]
    return statements.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id"), *own)


def crossing(g: Graph) -> DataFrame:
    """An entity other than a hub whose ties stand in three registers or more."""
    ends = both_ends(g.statements, "statement_id", "confidence", "sources")
    seen = ends.groupBy("entity_id").agg(
        F.collect_set("statement_id").alias("ids"), F.array_distinct(F.flatten(F.collect_set("sources"))).alias("registers"), F.min("confidence").alias("least")
    ).where(F.size("registers") >= 3)
    own = g.entities.where(~F.col("entity_type").isin(*HUB_TYPES)).select("entity_id", "name")
    joined = seen.join(own, "entity_id")
    return _candidate(joined, "CROSSING", F.array("entity_id"), F.col("ids"), _slots(entity="name", n_registers=F.size("registers")), None, "least")


def new_on_register(g: Graph, days: int = 30) -> DataFrame:
    """Ties that began in the last days before the view's date, or after it."""
    recent = g.statements.where(F.col("valid_from") >= F.date_sub(F.lit(g.as_of).cast("date"), days))
    joined = recent.join(g.named("subject"), "subject_id").join(g.named("object"), "object_id")
    slots = _slots(subject="subject", statement_type="statement_type", object="object", valid_from="valid_from")
    return _candidate(joined, "NEW_ON_REGISTER", F.array("subject_id", "object_id"), F.array("statement_id"), slots, None, "confidence")


SHAPES: dict[str, Callable[[Graph], DataFrame]] = {
    "LOOP_CLOSED": loop_closed,
    "SHARED_BENCH": shared_bench,
    "FAMILY_DESK": family_desk,
    "BIG_MONEY": big_money,
    "OVERSEAS_MONEY": overseas_money,
    "SECTOR_OVERLAP": sector_overlap,
    "QUIET_PORTFOLIO": quiet_portfolio,
    "CROSSING": crossing,
    "NEW_ON_REGISTER": new_on_register,
}


def score(g: Graph, candidates: DataFrame) -> DataFrame:
    """Findings with rarity, corroboration, money and surprise; those below the gate go.

    The id is of the shape and its sorted members; a new tie's type is part of it, as
    two ties of different types may begin at one time.
    """
    key = F.concat_ws("|", "shape_code", F.array_join(F.array_sort("member_ids"), ","), F.when(F.col("shape_code") == "NEW_ON_REGISTER", F.col("slots")["statement_type"]))
    # Written once, as members, statements and the findings themselves are taken from them.
    kept = written(candidates.where(F.col("min_confidence") >= GATE).withColumn("finding_id", F.md5(key)))
    known = idf(g).where(~F.col("entity_type").isin(*HUB_TYPES)).select(F.col("entity_id").alias("member_id"), "idf")
    members = kept.select("finding_id", F.explode("member_ids").alias("member_id")).join(known, "member_id")
    rarity = members.groupBy("finding_id").agg(F.exp(F.avg(F.log("idf"))).alias("rarity"))
    cited = kept.select("finding_id", F.explode("statement_ids").alias("statement_id")).join(statement_sources(g.statements), "statement_id")
    registers = cited.groupBy("finding_id").agg(F.count_distinct("source_code").alias("n_registers"))
    joined = kept.join(rarity, "finding_id", "left").join(registers, "finding_id", "left")
    weights = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    rare = F.coalesce("rarity", F.lit(0.0))
    agreed = 1 + 0.5 * F.greatest(F.lit(0), F.coalesce("n_registers", F.lit(1)) - 1)
    money = F.coalesce(F.least(F.lit(1.0), F.log10(1 + F.col("total_gbp")) / 6), F.lit(0.0))
    weight = weights[F.col("shape_code")]
    surprise = weight * (0.4 + 0.6 * rare) * agreed * (0.5 + 0.5 * money)
    return joined.select(
        "finding_id", "shape_code", "member_ids", "statement_ids", "slots", rounded(rare, 4).alias("rarity"), rounded(agreed, 4).alias("corroboration"),
        rounded(money, 4).alias("money"), weight.alias("shape_weight"), rounded(surprise, 4).alias("surprise"),
        rounded(F.col("min_confidence"), 4).alias("min_confidence"), (F.col("min_confidence") < FACT).alias("is_lead"),
    )


def findings(g: Graph, *shapes: str) -> DataFrame:
    """Scored findings of the given shapes, or of all."""
    return score(g, reduce(DataFrame.unionByName, (SHAPES[s](g) for s in shapes or SHAPES)))


def suggested_pairs(g: Graph, found: DataFrame, limit: int = 40) -> DataFrame:
    """(pair_id, from_id, to_id, why, surprise): the least connected pair of each family finding, best first."""
    facts = found.where("shape_code in ('LOOP_CLOSED', 'FAMILY_DESK') and not is_lead")
    member = facts.select("finding_id", "slots", F.explode("member_ids").alias("member")).join(degree(g).withColumnRenamed("entity_id", "member"), "member", "left")
    other = member.select("finding_id", F.col("member").alias("other"), F.col("degree").alias("other_degree"))
    pairs = member.join(other, "finding_id").where("member < other").withColumn("total", F.col("degree") + F.col("other_degree"))
    order = F.struct(F.col("total").isNotNull(), "total", "member", "other")
    best = pairs.groupBy("finding_id").agg(F.min_by(F.struct("member", "other", "slots", "total"), order).alias("p")).select("finding_id", "p.*")
    why = F.concat(F.lit("Linked through "), F.coalesce(F.col("slots")["company"], F.lit("the same company")), F.lit(", sharing the surname "), F.coalesce(F.col("slots")["surname"], F.lit("")), F.lit("."))
    ranked = best.withColumn("why", why).groupBy("member", "other").agg(F.min_by(F.struct("why", "total"), F.struct(F.col("total").isNull(), "total", "finding_id")).alias("p"))
    rows = ranked.select(
        F.md5(F.concat_ws("|", F.lit("PAIR"), "member", "other")).alias("pair_id"), F.col("member").alias("from_id"), F.col("other").alias("to_id"), "p.why",
        rounded(1 / (1 + F.coalesce("p.total", F.lit(0))), 4).alias("surprise"), F.col("p.total").alias("total"),
    )
    return rows.orderBy(F.asc_nulls_last("total"), "from_id", "to_id").limit(limit).drop("total")


def _overseas(g: Graph, keys: DataFrame, least_gbp: int) -> tuple[DataFrame, DataFrame]:
    """Large donors (donor_id, donor, total, top, name_key) and persons abroad (officer_id, officer, country, name_key)."""
    persons = g.entities.where("entity_type = 'person'")
    gifts = _gifts(g).join(persons.select(F.col("entity_id").alias("donor_id")), "donor_id", "left_semi")
    first = F.max_by(F.struct("recipient", "amount_gbp"), F.struct("amount_gbp", "recipient", "recipient_id")).alias("top")
    donors = gifts.groupBy("donor_id", "donor").agg(F.sum("amount_gbp").alias("total"), first).where(F.col("total") >= least_gbp)
    own = keys.where("name_key != ''")
    officers = persons.where("jurisdiction != 'GB'").join(own, "entity_id").select(F.col("entity_id").alias("officer_id"), F.col("name").alias("officer"), F.col("jurisdiction").alias("country"), "name_key")
    return donors.join(own, F.col("donor_id") == F.col("entity_id")).drop("entity_id"), officers


def _lead_id(donor: Column, officer: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit("OVERSEAS_LEAD"), donor, officer))


def _by_name(donors: DataFrame, others: DataFrame) -> DataFrame:
    """``donors`` with the rows of ``others`` that have their name key.

    The donors of a name are dealt out in SALTS shares and each share meets all of ``others``, so the pairs of
    a name are made in many tasks. They are not shuffled.
    """
    # A number of its own, so that small tables are not put together into few tasks: their pairs are many.
    parts = int(donors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = donors.withColumn("salt", F.pmod(F.xxhash64("donor_id"), F.lit(SALTS)).cast("int")).repartition(parts, "name_key", "salt")
    sent = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(parts, "name_key", "salt")
    return sent.hint("merge").join(own, ["name_key", "salt"]).drop("salt")


def overseas_leads(g: Graph, keys: DataFrame, least_gbp: int = 250_000) -> DataFrame:
    """Large donors who share a name key with another person abroad.

    keys: (entity_id, name_key) of persons. It is a row for each pair, so a name that a share of
    all persons have makes the square of that share.
    """
    donors, officers = _overseas(g, keys, least_gbp)
    return _by_name(donors, officers).where("donor_id != officer_id").select(
        _lead_id(F.col("donor_id"), F.col("officer_id")).alias("lead_id"), "donor_id", F.col("donor").alias("donor_name"),
        F.col("officer").alias("officer_name"), "country", F.col("top.amount_gbp").alias("amount_gbp"), F.col("top.recipient").alias("recipient"),
    )


def overseas_donors(g: Graph, keys: DataFrame, least_gbp: int = 250_000) -> DataFrame:
    """(donor_id): the donors of ``overseas_leads``, without making their pairs.

    keys: one name key of each person. Of the persons abroad of a name, the least and the largest id tell
    whether one of them is another person than the donor.
    """
    donors, officers = _overseas(g, keys, least_gbp)
    ends = officers.groupBy("name_key").agg(F.min("officer_id").alias("least"), F.max("officer_id").alias("most"))
    met = donors.select("donor_id", "name_key").hint("merge").join(ends, "name_key")
    return met.where("donor_id != least or donor_id != most").select("donor_id")


def overseas_places(g: Graph, keys: DataFrame, least_gbp: int = 250_000, listed: int = LISTED) -> DataFrame:
    """(donor_id, lead_id, place): the ``overseas_leads`` of each donor in order of id.

    keys: one name key of each person. The persons abroad of a name are one list, and a donor's leads are made and
    sorted within the donor's row, so pairs are neither shuffled nor sorted. Names with more than
    ``listed`` persons abroad would make long rows; their pairs are shuffled and sorted.
    """
    donors, officers = _overseas(g, keys, least_gbp)
    own = donors.select("donor_id", "name_key")
    officers = checkpointed(officers.select("officer_id", "name_key"))
    many = checkpointed(officers.groupBy("name_key").agg(F.count("*").alias("n")).where(F.col("n") > listed).select("name_key"))
    lists = officers.join(many, "name_key", "left_anti").groupBy("name_key").agg(F.collect_list("officer_id").alias("officers"))
    others = F.filter("officers", lambda o: o != F.col("donor_id"))
    leads = F.sort_array(F.transform(others, lambda o: _lead_id(F.col("donor_id"), o)))
    short = _by_name(own, lists).select("donor_id", F.posexplode(leads).alias("before", "lead_id")).select("donor_id", "lead_id", (F.col("before") + 1).alias("place"))
    pairs = _by_name(own, officers.join(many, "name_key", "left_semi")).where("donor_id != officer_id").select("donor_id", _lead_id(F.col("donor_id"), F.col("officer_id")).alias("lead_id"))
    place = F.row_number().over(Window.partitionBy("donor_id").orderBy("lead_id"))
    return short.unionByName(pairs.withColumn("place", place))
