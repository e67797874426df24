"""Reads of the finished graph: paths, surroundings, boards, rankings and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .findings import Graph, both_ends
from .ranks import placed

# Names of registers.
REGISTERS = {
    "companies_house": "Companies House",
    "electoral_commission": "Electoral Commission",
    "parliament": "Parliament (Members API)",
    "parliament_interests": "Register of Members' Interests",
    "lords_interests": "Register of Lords' Interests",
    "contracts_finder": "Contracts Finder",
}
# The register that a type of statement most likely comes from, where its sources aren't known.
TYPE_REGISTERS = {
    "DONATED_TO": "Electoral Commission",
    "CONTRACTED_WITH": "Contracts Finder",
    "DIRECTOR_OF": "Companies House",
    "PSC_OF": "Companies House",
    "OWNS": "Companies House",
    "CO_DIRECTOR": "Companies House",
    "ADVISER_TO": "Register of Members' Interests",
    "MEMBER_OF": "Parliament",
    "CHAIR_OF": "Parliament",
    "MINISTERIAL_ROLE": "Parliament",
}
UNKNOWN_REGISTER = "official register"
#: A finding shape that lists leave out.
UNLISTED = "QUIET_PORTFOLIO"
STRENGTH_ORDER = {"strong": 0, "medium": 1, "low": 2}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "Established").when(confidence >= 0.5, "Probable").otherwise("Lead")


def strength_band(strength: Column) -> Column:
    return F.when(strength >= 0.75, "very strong").when(strength >= 0.5, "strong").when(strength >= 0.25, "moderate").otherwise("weak")


def pounds(amount: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(F.round(amount, 0), 0))


def links(g: Graph) -> DataFrame:
    """Statements as a reader sees them: relation, registers, amount as text, tier and band."""
    told = F.array_join(F.transform("sources", lambda s: F.coalesce(_map(REGISTERS)[s], s)), " + ")
    likely = F.coalesce(_map(TYPE_REGISTERS)[F.col("statement_type")], F.lit(UNKNOWN_REGISTER))
    label = F.when(F.size("sources") > 0, told).otherwise(likely)
    return g.statements.select(
        "statement_id", "subject_id", "object_id", F.lower(F.replace("statement_type", F.lit("_"), F.lit(" "))).alias("relation"), label.alias("method"),
        pounds(F.col("amount_gbp")).alias("amount"), "confidence", "strength", tier(F.col("confidence")).alias("tier"), strength_band(F.col("strength")).alias("band"),
    )


def nodes(g: Graph) -> DataFrame:
    """Entities with their number of ties and an importance from 4 to 10."""
    ties = both_ends(g.statements).groupBy("entity_id").agg(F.count("*").alias("ties"))
    joined = g.entities.join(ties, "entity_id", "left").withColumn("ties", F.coalesce("ties", F.lit(0)))
    importance = F.greatest(F.lit(4), F.least(F.lit(10), 4 + F.col("ties")))
    return joined.select("entity_id", "entity_type", "name", "category", "jurisdiction", "ties", importance.alias("importance"))


def present_types(g: Graph) -> DataFrame:
    return g.entities.groupBy("entity_type").agg(F.count("*").alias("n"))


def ties_of(g: Graph, entity_id: str) -> DataFrame:
    """All ties of one entity with the other end, by relation, the relation with the best tie first."""
    s = g.statements
    away = s.where(F.col("subject_id") == entity_id).withColumn("direction", F.lit("out")).withColumn("other_id", F.col("object_id"))
    here = s.where((F.col("object_id") == entity_id) & (F.col("subject_id") != entity_id)).withColumn("direction", F.lit("in")).withColumn("other_id", F.col("subject_id"))
    score = 2 * F.col("strength") + F.col("confidence")
    rows = away.unionByName(here).join(g.named("other"), "other_id").withColumn("score", F.round(score, 4))
    best = F.max("score").over(Window.partitionBy("statement_type"))
    place = F.row_number().over(Window.partitionBy("statement_type").orderBy(F.desc("score"), "statement_id"))
    return rows.select("statement_type", "direction", "other_id", "other", "confidence", "strength", "score", best.alias("group_score"), place.alias("place"))


def conflict_board(g: Graph, scores: DataFrame) -> DataFrame:
    """Parliamentarians with a conflict in order. scores: (entity_id, scrutiny)."""
    flagged = g.conflicts.where("conflict_flag").join(scores.select("entity_id", "scrutiny"), "entity_id").join(nodes(g).select("entity_id", "name", "importance"), "entity_id")
    rank = _map(STRENGTH_ORDER)[F.col("conflict_strength")]
    board = flagged.select("entity_id", "name", "conflict_strength", "conflict_overlap", "scrutiny", "importance", rank.alias("_rank"))
    return placed(board, F.asc("_rank"), F.desc("scrutiny"), F.desc("importance"), F.asc("name"), F.asc("entity_id")).drop("_rank", "n_places")


def money_board(g: Graph, limit: int = 8, behind: int = 4) -> DataFrame:
    """The largest gifts to parties, with some of the people behind each donor."""
    parties = g.entities.where("entity_type = 'party'").select(F.col("entity_id").alias("object_id"), F.col("name").alias("party"))
    top = g.of("DONATED_TO").where("amount_gbp is not null").join(parties, "object_id").orderBy(F.desc("amount_gbp"), "statement_id").limit(limit)
    top = top.join(g.named("donor"), F.col("subject_id") == F.col("donor_id")).select("statement_id", "donor_id", "donor", "object_id", "party", "amount_gbp")
    held = g.of("DIRECTOR_OF", "PSC_OF", "OWNS")
    ends = F.explode(F.array(F.struct(F.col("subject_id").alias("d"), F.col("object_id").alias("o")), F.struct(F.col("object_id").alias("d"), F.col("subject_id").alias("o"))))
    around = held.select(ends.alias("x")).select(F.col("x.d").alias("donor_id"), F.col("x.o").alias("other_id")).distinct()
    near = top.select("statement_id", "donor_id", "object_id").join(around, "donor_id").where("other_id != object_id").join(g.named("other"), "other_id")
    place = F.row_number().over(Window.partitionBy("statement_id").orderBy("other_id"))
    few = near.withColumn("place", place).where(F.col("place") <= behind).groupBy("statement_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other_id", "other"))), lambda x: x["other"]), ", ").alias("behind")
    )
    return top.join(few, "statement_id", "left").select("statement_id", "donor", "party", "amount_gbp", F.coalesce("behind", F.lit("")).alias("behind"))


def concentrations(g: Graph, people: int = 3) -> DataFrame:
    """Organisations that several persons meet at, or that both give and win contracts."""
    kind = g.entities.select("entity_id", "entity_type")
    ends = F.explode(F.array(
        F.struct(F.col("subject_id").alias("o"), F.col("object_id").alias("p"), F.lit(True).alias("first")), F.struct(F.col("object_id").alias("o"), F.col("subject_id").alias("p"), F.lit(False).alias("first")),
    ))
    sides = g.statements.select("statement_type", ends.alias("x")).select("statement_type", "x.*")
    orgs = g.entities.where("entity_type in ('company', 'organisation')").select(F.col("entity_id").alias("o"), "name")
    rows = sides.join(orgs, "o").join(kind.select(F.col("entity_id").alias("p"), "entity_type"), "p", "left")
    found = rows.groupBy("o", "name").agg(
        F.count_distinct(F.when(F.col("entity_type") == "person", F.col("p"))).alias("n_people"),
        F.bool_or((F.col("statement_type") == "DONATED_TO") & F.col("first")).alias("donor"),
        F.bool_or(F.col("statement_type") == "CONTRACTED_WITH").alias("contractor"),
    )
    return found.where((F.col("donor") & F.col("contractor")) | (F.col("n_people") >= people)).select(F.col("o").alias("entity_id"), "name", "n_people", "donor", "contractor")


def register_names(g: Graph) -> DataFrame:
    """The different register labels in the graph."""
    return links(g).select(F.explode(F.split("method", " \\+ ")).alias("register")).distinct()


def incident(g: Graph, entity_id: str) -> DataFrame:
    return g.statements.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))


def ego(g: Graph, entity_id: str, limit: int = 40) -> DataFrame:
    """Statements among an entity and the other ends of its strongest ties."""
    top = incident(g, entity_id).orderBy(F.desc("strength"), "statement_id").limit(limit)
    members = both_ends(top).distinct()
    return induced(g, members)


def induced(g: Graph, members: DataFrame) -> DataFrame:
    """Statements with both ends in ``members`` (entity_id)."""
    a, b = members.select(F.col("entity_id").alias("subject_id")), members.select(F.col("entity_id").alias("object_id"))
    return g.statements.join(a, "subject_id", "left_semi").join(b, "object_id", "left_semi")


def _adjacent(g: Graph, least: float) -> DataFrame:
    """(a, b, strength) in either direction of ties with so much confidence."""
    ends = F.explode(F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b"))))
    return g.statements.where(F.col("confidence") * 100 >= least).select(ends.alias("x"), "strength").select("x.a", "x.b", "strength").groupBy("a", "b").agg(F.max("strength").alias("strength"))


def shortest_path(g: Graph, start: str, goal: str, least: float = 0) -> DataFrame:
    """(hop, entity_id) along a shortest path; of equal ones the least in order of ids. Empty if there is none.

    The frontier is a table; each step joins it to the ties, until it meets the goal or is
    empty, however long the path.
    """
    spark = g.entities.sparkSession
    step = checkpointed(_adjacent(g, least).select("a", "b"))
    front = before = checkpointed(spark.createDataFrame([(start, [start])], "entity_id string, path array<string>"))
    at_goal = front.where(F.col("entity_id") == goal)
    while at_goal.isEmpty() and not front.isEmpty():
        reached = front.join(step, F.col("entity_id") == F.col("a")).groupBy("b").agg(F.min("path").alias("path"))
        # Ties lead both ways, so what was seen before the last two steps is out of reach.
        seen = front.select("entity_id").unionByName(before.select("entity_id"))
        new = reached.join(seen, reached.b == seen.entity_id, "left_anti").select(F.col("b").alias("entity_id"), F.concat("path", F.array("b")).alias("path"))
        front, before = checkpointed(new), front
        at_goal = front.where(F.col("entity_id") == goal)
    return at_goal.select(F.posexplode("path").alias("hop", "entity_id"))


def path_summary(g: Graph, path: DataFrame) -> DataFrame:
    """One row: number of steps, the weakest of the best ties along the way, different sources."""
    after = path.select((F.col("hop") - 1).alias("hop"), F.col("entity_id").alias("to_id"))
    steps = path.join(after, "hop").select("hop", F.least("entity_id", "to_id").alias("a"), F.greatest("entity_id", "to_id").alias("b"))
    ties = g.statements.select(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b"), "confidence", "sources")
    best = steps.join(ties, ["a", "b"]).groupBy("hop").agg(F.max("confidence").alias("confidence"), F.flatten(F.collect_set("sources")).alias("sources"))
    return best.agg(F.count("*").alias("steps"), F.min("confidence").alias("weakest"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).cast("long").alias("n_sources"))


def surroundings(g: Graph, entity_id: str, hops: int = 2, cap: int = 150, least: float = 0) -> DataFrame:
    """(entity_id, hop) of what is near an entity; within a hop the strongest ties come first, up to ``cap`` in all."""
    spark = g.entities.sparkSession
    step = checkpointed(_adjacent(g, least))
    seen = checkpointed(spark.createDataFrame([(entity_id, 0)], "entity_id string, hop int"))
    for hop in range(1, hops + 1):
        room = cap - seen.count()
        if room <= 0:
            break
        front = seen.where(F.col("hop") == hop - 1)
        reached = front.join(step, F.col("entity_id") == F.col("a")).groupBy("b").agg(F.max("strength").alias("strength"))
        new = reached.join(seen, reached.b == seen.entity_id, "left_anti").orderBy(F.desc("strength"), "b").limit(room)
        seen = checkpointed(seen.unionByName(new.select(F.col("b").alias("entity_id"), F.lit(hop).alias("hop"))))
    return seen


def constellation(g: Graph, found: DataFrame, most_nodes: int = 300, gifts: int = 25, busiest: int = 50) -> DataFrame:
    """(entity_id, source, place): members of findings, then ends of the largest gifts, then the busiest entities."""
    members = found.select(F.explode("member_ids").alias("entity_id"), "surprise").groupBy("entity_id").agg(F.max("surprise").alias("weight")).withColumn("source", F.lit(1))
    top = g.of("DONATED_TO").where("amount_gbp is not null").orderBy(F.desc("amount_gbp"), "statement_id").limit(gifts)
    ends = both_ends(top, "amount_gbp").groupBy("entity_id").agg(F.max("amount_gbp").cast("double").alias("weight")).withColumn("source", F.lit(2))
    busy = nodes(g).orderBy(F.desc("ties"), "entity_id").limit(busiest).select("entity_id", F.col("ties").cast("double").alias("weight"), F.lit(3).alias("source"))
    every = members.unionByName(ends).unionByName(busy)
    first = every.groupBy("entity_id").agg(F.min(F.struct("source", (-F.col("weight")).alias("less"))).alias("k")).select("entity_id", "k.source", "k.less")
    chosen = first.orderBy("source", "less", "entity_id").limit(most_nodes)
    return chosen.select("entity_id", "source", F.row_number().over(Window.orderBy("source", "less", "entity_id")).alias("place"))


def constellation_links(g: Graph, members: DataFrame, most: int = 900, least: float = 0.5) -> DataFrame:
    """The strongest tie of each pair among ``members``, up to ``most``.

    Ties of little confidence count if both ends are members of findings (source 1).
    """
    told = members.where("source = 1")
    inside = induced(g, members)
    inside = inside.where(F.col("confidence") >= least).unionByName(induced(g, told).where(F.col("confidence") < least))
    ends = [F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")]
    best = inside.where("subject_id != object_id").groupBy(*ends).agg(F.max("strength").alias("strength"))
    return best.orderBy(F.desc("strength"), "a", "b").limit(most)


def spark_finding(found: DataFrame, entity_id: str) -> DataFrame:
    """The most surprising finding that has an entity as member."""
    return found.where(F.array_contains("member_ids", entity_id)).orderBy(F.desc("surprise"), "finding_id").limit(1)


def evidence(g: Graph, finding: DataFrame, most: int = 12) -> DataFrame:
    """Statements that a finding rests on; without any, those among its members."""
    cited = g.statements.join(finding.select(F.explode("statement_ids").alias("statement_id")), "statement_id", "left_semi")
    among = induced(g, finding.where(F.size("statement_ids") == 0).select(F.explode("member_ids").alias("entity_id")))
    return cited.unionByName(among).orderBy(F.desc("strength"), "statement_id").limit(most)


def entity_ranking(g: Graph, scores: DataFrame) -> DataFrame:
    """Entities in order of conflict, scrutiny, importance and name, with their place."""
    rank = F.coalesce(_map(STRENGTH_ORDER)[F.col("conflict_strength")], F.lit(3))
    known = nodes(g).join(scores.select("entity_id", "scrutiny"), "entity_id").join(g.conflicts.select("entity_id", "conflict_strength"), "entity_id", "left")
    return known.select("entity_id", "name", rank.alias("conflict_rank"), "scrutiny", "importance")


def search(ranked: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Entities whose name contains the query, best first."""
    hits = ranked.where(F.contains(F.lower("name"), F.lit(query.lower())))
    return hits.orderBy("conflict_rank", F.desc("scrutiny"), F.desc("importance"), "name", "entity_id").limit(limit)


def ledger(found: DataFrame, sort: str = "surprise", shape: str | None = None, least_gbp: float | None = None) -> DataFrame:
    """Findings for a list, by surprise, money or newness (undated last), with amount and date from their slots."""
    amount = F.coalesce(F.col("slots")["amount_gbp"], F.col("slots")["donation_total_gbp"]).try_cast("decimal(28,2)")
    rows = found.withColumn("amount_gbp", amount).withColumn("dated", F.try_to_date(F.col("slots")["valid_from"]))
    if shape:
        rows = rows.where(F.col("shape_code") == shape)
    if least_gbp is not None:
        rows = rows.where(F.col("amount_gbp") >= least_gbp)
    order = {"surprise": F.desc("surprise"), "money": F.desc_nulls_last("amount_gbp"), "newest": F.desc_nulls_last("dated")}[sort]
    return rows.orderBy(order, F.desc("surprise"), "finding_id")


def lead_pick(found: DataFrame, covered: DataFrame) -> DataFrame:
    """The finding to lead with: surprise, lifted for some shapes and where the news covers a member. covered: (entity_id)."""
    boost = F.when(F.col("shape_code").isin("LOOP_CLOSED", "SECTOR_OVERLAP"), 1.5).when(F.col("shape_code").isin("FAMILY_DESK", "OVERSEAS_MONEY"), 1.3).otherwise(1.0)
    news = found.select("finding_id", F.explode("member_ids").alias("entity_id")).join(covered, "entity_id", "left_semi").select("finding_id").distinct().withColumn("news", F.lit(1.3))
    rows = found.join(news, "finding_id", "left").withColumn("score", F.round(F.col("surprise") * boost * F.coalesce("news", F.lit(1.0)), 4))
    return rows.orderBy(F.desc("score"), "finding_id").limit(1)


def listed(found: DataFrame) -> DataFrame:
    """The findings that lists show, with their place: the most surprising first."""
    return placed(found.where(F.col("shape_code") != UNLISTED), F.desc("surprise"), F.asc("finding_id")).drop("n_places")


def by_entity(df: DataFrame, entity: str, *order: Column) -> DataFrame:
    """``df`` with each row's place among those of its entity."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))


def insights_by_entity(df: DataFrame) -> DataFrame:
    """Insights with their place among an entity's, the weightiest first."""
    return by_entity(df, "entity_id", F.desc("priority"), F.asc("insight_id"))


def extras(coverage: DataFrame | None, offshore: DataFrame | None, overseas: DataFrame | None) -> DataFrame:
    """(extra, entity_id, id, place) of news, offshore and overseas leads; a table that isn't there (None) has none.

    News is in order of time, the newest first, leads in order of id. ``overseas`` may have its places
    already, as ``findings.overseas_places`` gives them without a shuffle of all leads.
    """
    parts = []
    if coverage is not None:
        parts.append(by_entity(coverage, "entity_id", F.desc("seendate"), F.asc("coverage_id")).select(F.lit("coverage").alias("extra"), "entity_id", F.col("coverage_id").alias("id"), "place"))
    if offshore is not None:
        parts.append(by_entity(offshore, "entity_id", F.asc("lead_id")).select(F.lit("offshore").alias("extra"), "entity_id", F.col("lead_id").alias("id"), "place"))
    if overseas is not None:
        placed_ = overseas if "place" in overseas.columns else by_entity(overseas, "donor_id", F.asc("lead_id"))
        parts.append(placed_.select(F.lit("overseas").alias("extra"), F.col("donor_id").alias("entity_id"), F.col("lead_id").alias("id"), "place"))
    return reduce(DataFrame.unionByName, parts)


def by_id(df: DataFrame, column: str, value: str) -> DataFrame:
    """The row with an id, as a filter that reaches the scan."""
    return df.where(F.col(column) == value)


def news_of(found: DataFrame, coverage: DataFrame, most: int | None = None) -> DataFrame:
    """(finding_id, coverage_id, place): news of each finding's members, each article once, in order of members and time.

    coverage: (coverage_id, entity_id, seendate).
    """
    members = found.select("finding_id", F.posexplode("member_ids").alias("member", "entity_id"))
    seen = members.join(coverage.select("coverage_id", "entity_id", "seendate"), "entity_id")
    once = seen.groupBy("finding_id", "coverage_id").agg(F.min(F.struct("member", "entity_id")).alias("m"), F.max("seendate").alias("seendate"))
    rows = once.withColumn("place", F.row_number().over(Window.partitionBy("finding_id").orderBy("m.member", F.desc("seendate"), "coverage_id")))
    return (rows if most is None else rows.where(F.col("place") <= most)).select("finding_id", "coverage_id", "place")


#: The slots that name the member that a finding is about, by shape.
PIVOT_SLOTS = {
    "LOOP_CLOSED": ("company", "entity"), "CROSSING": ("company", "entity"), "BIG_MONEY": ("donor",), "OVERSEAS_MONEY": ("donor",), "SHARED_BENCH": ("org",), "FAMILY_DESK": ("company",),
}


def pivot_entity(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(finding_id, pivot_id): the first member with the name that the shape's slots give, else the first member."""
    members = found.select("finding_id", "shape_code", "slots", F.posexplode("member_ids").alias("at", "entity_id"))
    named = members.join(entities.select("entity_id", "name"), "entity_id", "left")
    order = F.lit(9)
    for shape, slots in PIVOT_SLOTS.items():
        for k, slot in reversed([*enumerate(slots)]):
            order = F.when((F.col("shape_code") == shape) & (F.col("slots")[slot] == F.col("name")), k).otherwise(order)
    return named.groupBy("finding_id").agg(F.min_by("entity_id", F.struct(order.alias("o"), "at")).alias("pivot_id"))


def suggestions(found: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """(entity_id, name, place): the first different entities that the most surprising findings are about."""
    about = pivot_entity(found, entities).join(found.select("finding_id", "surprise"), "finding_id").join(entities.select(F.col("entity_id").alias("pivot_id"), "name"), "pivot_id")
    best = about.groupBy("pivot_id", "name").agg(F.min(F.struct((-F.col("surprise")).alias("less"), "finding_id")).alias("first"))
    top = best.orderBy("first").limit(most)
    return top.select(F.col("pivot_id").alias("entity_id"), "name", F.row_number().over(Window.orderBy("first")).alias("place"))


def find_parliamentarians(g: Graph, query: str, limit: int = 7) -> DataFrame:
    """Members, ministers and peers whose name contains the query."""
    kinds = ("mp", "minister", "peer")
    own = g.entities.where(F.col("entity_type").isin(*kinds) | F.col("category").isin(*kinds))
    return own.where(F.contains(F.lower("name"), F.lit(query.strip().lower()))).orderBy("name", "entity_id").limit(limit).select("entity_id", "name")


def set_hash(ids: Column) -> Column:
    """A short text for a set of ids: their rolling 32-bit hash in base 36, and their number."""
    ordered = F.array_sort(ids)
    chars = F.split(F.concat(F.array_join(ordered, "|"), F.lit("|")), "")
    rolled = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.concat(F.lower(F.conv(F.when(F.size(ids) > 0, rolled).otherwise(0).cast("string"), 10, 36)), F.lit(":"), F.size(ids).cast("string"))


#: A weighted draw beyond the first card looks at so many findings in the order drawn before it lets a shape or member repeat.
TRIES = 30


def hand(found: DataFrame, seed: int | str = 1, slots: int = 4, fade: float = 25.0, top: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """A seeded draw of ``slots`` findings with their ``card``, 1 on; ``seen`` (finding_id) are left out.

    Card 1 is drawn evenly from the ``top`` most surprising. The others are drawn from all
    findings with the weight exp(-rank / fade), without putting back, and share neither
    shape nor member with a card before; if none of TRIES draws does, the first one stays.
    Draws are by hashed exponential keys over the whole pool; each card looks at the first
    TRIES keys and what is in hand, so that little reaches one task.
    """
    pool = found if seen is None else found.join(seen.select("finding_id"), "finding_id", "left_anti")
    pool = listed(pool).withColumn("rank", F.col("place") - 1)

    def key(card: int) -> Column:
        uniform = (F.pmod(F.xxhash64("finding_id", F.lit(str(seed)), F.lit(card)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        return -F.log(uniform) * (F.exp(F.col("rank") / fade) if card > 1 else F.lit(1.0))

    pool = checkpointed(pool.select("finding_id", "shape_code", "member_ids", "surprise", "rank"))
    held: DataFrame | None = None
    for card in range(1, slots + 1):
        left = pool.where(F.col("rank") < top) if held is None else pool.join(held.select("finding_id"), "finding_id", "left_anti")
        drawn = left.withColumn("_key", key(card)).orderBy("_key", "finding_id").limit(TRIES)
        if held is not None:
            used = held.agg(F.collect_set("shape_code").alias("_shapes"), F.array_distinct(F.flatten(F.collect_list("member_ids"))).alias("_members"))  # one row, a hand
            clash = F.array_contains("_shapes", F.col("shape_code")) | F.arrays_overlap("_members", "member_ids")
            drawn = drawn.crossJoin(F.broadcast(used)).withColumn("_clash", clash).orderBy("_clash", "_key", "finding_id").drop("_shapes", "_members", "_clash")
        picked = checkpointed(drawn.limit(1).drop("_key").withColumn("card", F.lit(card)))
        held = picked if held is None else checkpointed(held.unionByName(picked))
    return held.drop("rank")


def strongest_money_tie(g: Graph, entity_id: str) -> DataFrame:
    return incident(g, entity_id).where("amount_gbp is not null").orderBy(F.desc("amount_gbp"), "statement_id").limit(1)


def between(g: Graph, a: str, b: str, most: int = 12) -> DataFrame:
    """Ties of two entities in either direction."""
    pair = (F.least("subject_id", "object_id") == min(a, b)) & (F.greatest("subject_id", "object_id") == max(a, b))
    return g.statements.where(pair).orderBy(F.desc("strength"), "statement_id").limit(most)


def hidden_links(g: Graph, least: float = 40) -> DataFrame:
    """One row: ties below a confidence threshold, and all."""
    return g.statements.agg(F.count_if(F.col("confidence") * 100 < least).alias("hidden"), F.count("*").alias("n"))


def visible_neighbours(g: Graph, entity_id: str, least: float = 40, types: tuple[str, ...] | None = None) -> DataFrame:
    """Other ends of an entity's ties above a threshold, of some types."""
    near = _adjacent(g, least).where(F.col("a") == entity_id).join(g.entities, F.col("b") == F.col("entity_id"))
    if types:
        near = near.where(F.col("entity_type").isin(*types))
    return near.select("entity_id", "name", "entity_type", "strength")


def receipts(g: Graph, title: str, ties: DataFrame) -> DataFrame:
    """One row of Markdown that lists ties with their registers; ``ties`` is a short list."""
    named = ties.join(g.named("subject"), "subject_id").join(g.named("object"), "object_id")
    line = F.concat(F.lit("- "), "subject", F.lit(" | "), F.lower("statement_type"), F.lit(" | "), "object", F.lit(" ("), F.array_join("sources", ", "), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("statement_id", line.alias("line"))))
    return named.agg(F.concat(F.lit(f"# {title}\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("markdown"))
