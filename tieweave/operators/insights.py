"""Insights: what is notable about each entity, and statistics of the whole register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.text import rounded as _rounded
from ..schemas import HUB_TYPES
from .findings import Graph, _slots, both_ends, degree
from .ranks import ranked


def registers(g: Graph) -> DataFrame:
    """(entity_id, registers, n_registers): the sources of its ties, sorted."""
    seen = both_ends(g.statements, "sources").groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("registers"))
    return seen.withColumn("n_registers", F.size("registers").cast("long"))


def edges(g: Graph) -> DataFrame:
    """(a, b): every tie once in each direction."""
    s = g.statements
    both = F.explode(F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b"))))
    return s.select(both.alias("e")).select("e.a", "e.b").distinct()


def _insight(df: DataFrame, kind: str, priority: Column, slots: Column, rank: Column | None = None, size: Column | None = None, tag: str | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return df.select(
        F.md5(F.concat_ws("|", F.lit(kind), *([F.lit(tag)] if tag else []), "entity_id")).alias("insight_id"), "entity_id", F.lit(kind).alias("kind"),
        _rounded(priority, 4).alias("priority"), (none if rank is None else rank.cast("long")).alias("rank"), (none if size is None else size.cast("long")).alias("cohort_size"), slots.alias("slots"),
    )


def _share(weight: float = 1.0) -> Column:
    return weight * (1 - (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("cohort_size")))


def _money(g: Graph, own: str, other: str, kind: str, cohorts: tuple[str, str, str], list_name: str) -> DataFrame:
    gifts = g.of("DONATED_TO").where("amount_gbp is not null")
    total = gifts.groupBy(F.col(own).alias("entity_id")).agg(F.sum("amount_gbp").alias("total"), F.count("*").alias("n"))
    named = gifts.join(g.named("other"), F.col(other) == F.col("other_id")).groupBy(F.col(own).alias("entity_id"), "other").agg(F.sum("amount_gbp").alias("amount"))
    first = Window.partitionBy("entity_id").orderBy(F.desc("amount"), "other")
    top = named.withColumn("place", F.row_number().over(first)).where("place <= 3").groupBy("entity_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]), ", ").alias("top")
    )
    apart, a, b = cohorts
    cohort = F.when(F.col("entity_type") == apart, a).otherwise(b)
    known = total.join(g.entities.select("entity_id", "entity_type", "name"), "entity_id").join(top, "entity_id", "left").withColumn("cohort", cohort)
    places = ranked(known, "total", "cohort")
    slots = _slots(name="name", total_gbp="total", n_donations="n", cohort="cohort", percentile=_rounded(100 * _share(), 1).cast("decimal(5,1)"), **{list_name: "top"})
    return _insight(places, kind, _share(0.9), slots, F.col("rank"), F.col("cohort_size"))


def rank_money_given(g: Graph) -> DataFrame:
    return _money(g, "subject_id", "object_id", "RANK_MONEY_GIVEN", ("person", "person", "company"), "recipients")


def rank_money_received(g: Graph) -> DataFrame:
    return _money(g, "object_id", "subject_id", "RANK_MONEY_RECEIVED", ("party", "party", "person"), "donors")


def rank_portfolio(g: Graph) -> DataFrame:
    """Parliamentarians by their number of directorships, holdings and advisory roles."""
    mps = g.entities.where("category = 'mp'").select(F.col("entity_id").alias("subject_id"), "name")
    kinds = g.of("DIRECTOR_OF", "OWNS", "ADVISER_TO").join(mps, "subject_id").groupBy("subject_id", "name", "statement_type").agg(F.count("*").alias("n"))
    breakdown = F.transform(F.array_sort(F.collect_list(F.struct("statement_type", "n"))), lambda x: F.concat_ws(":", x["statement_type"], x["n"].cast("string")))
    held = kinds.groupBy(F.col("subject_id").alias("entity_id"), "name").agg(F.sum("n").alias("n_ties"), F.array_join(breakdown, ",").alias("kinds"))
    slots = _slots(name="name", n_ties="n_ties", kinds_breakdown="kinds", percentile=_rounded(100 * _share(), 1).cast("decimal(5,1)"))
    return _insight(ranked(held, "n_ties"), "RANK_PORTFOLIO", _share(0.85), slots, F.col("rank"), F.col("cohort_size"))


def _only(g: Graph, own: DataFrame, tag: str) -> DataFrame:
    size = own.agg(F.count("*").alias("set_size"))
    sized = own.crossJoin(F.broadcast(size)).join(g.entities.select("entity_id", "name"), "entity_id")  # one row
    return _insight(sized, "ONLY_N", 1 / F.col("set_size"), _slots(name="name", set_size="set_size", set=F.lit(tag)), None, F.col("set_size"), tag)


def only_donor_contractor(g: Graph) -> DataFrame:
    donors = g.of("DONATED_TO").select(F.col("subject_id").alias("entity_id")).distinct()
    return _only(g, donors.join(g.of("CONTRACTED_WITH").select(F.col("subject_id").alias("entity_id")), "entity_id", "left_semi"), "donor_contractor")


def _across(g: Graph) -> DataFrame:
    own = g.entities.where(~F.col("entity_type").isin(*HUB_TYPES)).select("entity_id", "name")
    return registers(g).where("n_registers >= 3").join(own, "entity_id")


def only_crossing(g: Graph) -> DataFrame:
    return _only(g, _across(g).select("entity_id"), "crossing")


def bridge(g: Graph) -> DataFrame:
    places = ranked(_across(g), "n_registers")
    slots = _slots(name="name", n_registers="n_registers", registers=F.array_join("registers", ","))
    return _insight(places, "BRIDGE", _share(0.6), slots, F.col("rank"), F.col("cohort_size"))


RANKED = (rank_money_given, rank_money_received, rank_portfolio, only_donor_contractor, only_crossing, bridge)


def nearest_notable(g: Graph, found: DataFrame, covered: DataFrame) -> DataFrame:
    """For each entity without an insight, a member of a finding within two steps.

    What grows with the entities is joined by sorting: as Parquet such a table is so small that it would be
    sent to the driver and broadcast long after it is large in memory.
    """
    facts = found.where("not is_lead")
    hint = F.coalesce(*(F.col("slots")[k] for k in ("company", "org", "person", "mp", "entity", "donor")))
    notable = facts.select("finding_id", "shape_code", hint.alias("hint"), F.explode("member_ids").alias("notable_id")).distinct()
    left = written(g.entities.select("entity_id").join(covered.select("entity_id").hint("merge"), "entity_id", "left_anti")).hint("merge")
    step = written(edges(g)).hint("merge")
    # Of each entity only the first finding matters, so every step keeps one row for each end.
    first = notable.groupBy("notable_id").agg(F.min(F.struct("finding_id", "shape_code", "hint")).alias("f"))
    first = written(first).hint("merge")
    near = left.join(step, left.entity_id == step.a).select("entity_id", F.col("b").alias("via")).join(first, F.col("via") == F.col("notable_id"))
    best = lambda df: df.groupBy("entity_id").agg(F.min(F.struct("f.finding_id", "notable_id", "f.shape_code", "f.hint")).alias("n"))
    hop1 = written(best(near).withColumn("hops", F.lit(1))).hint("merge")
    rest = left.join(hop1, "entity_id", "left_anti")
    reach = rest.join(step, rest.entity_id == step.a).select("entity_id", F.col("b").alias("via"))
    # Two best for each middle entity, as the first may be the start itself.
    beyond = step.join(first, F.col("b") == F.col("notable_id")).select(F.col("a").alias("via"), "notable_id", "f")
    order = Window.partitionBy("via").orderBy("f.finding_id", "notable_id")
    beyond = beyond.withColumn("place", F.row_number().over(order)).where("place <= 2").drop("place")
    hop2 = best(reach.join(beyond, "via").where("notable_id != entity_id")).withColumn("hops", F.lit(2))
    found2 = hop1.unionByName(hop2).select("entity_id", "n.*", "hops").join(g.named("notable").hint("merge"), "notable_id").join(g.entities.select("entity_id", "name").hint("merge"), "entity_id")
    headline = F.concat("shape_code", F.lit(":"), F.coalesce("hint", "notable"))
    return _insight(found2, "NEAREST_NOTABLE", 0.3 / F.col("hops"), _slots(name="name", notable_name="notable", headline=headline, hops="hops"))


def basic(g: Graph, covered: DataFrame) -> DataFrame:
    """An insight for every entity that has no other."""
    left = g.entities.select("entity_id", "name").join(covered.select("entity_id"), "entity_id", "left_anti")
    known = left.join(degree(g), "entity_id", "left").join(registers(g), "entity_id", "left")
    slots = _slots(name="name", n_ties=F.coalesce("degree", F.lit(0)), n_registers=F.coalesce("n_registers", F.lit(0)))
    return _insight(known, "BASIC", F.lit(0.05), slots)


def insights(g: Graph, found: DataFrame) -> DataFrame:
    """Every insight; each entity has one at least."""
    first = written(reduce(DataFrame.unionByName, (f(g) for f in RANKED)))
    some = first.unionByName(written(nearest_notable(g, found, first)))
    return some.unionByName(basic(g, some))


def register_stats(g: Graph) -> DataFrame:
    """(stat, value, detail): money, largest gift, paid ties, double roles, sizes, newest tie."""
    gifts = g.of("DONATED_TO").where("amount_gbp is not null")

    def row(df: DataFrame, stat: str, value: Column, *detail: Column) -> DataFrame:
        return df.select(F.lit(stat).alias("stat"), value.cast("decimal(28,2)").alias("value"), F.concat_ws("|", *detail).alias("detail"))

    money = gifts.agg(F.sum("amount_gbp").alias("v"), F.count("*").alias("n"), F.count_distinct("subject_id").alias("d"))
    top = gifts.orderBy(F.desc("amount_gbp"), "statement_id").limit(1).join(g.named("donor"), F.col("subject_id") == F.col("donor_id")).join(g.named("recipient"), F.col("object_id") == F.col("recipient_id"))
    paid = g.of("DIRECTOR_OF", "OWNS", "ADVISER_TO").join(g.entities.where("category = 'mp'").select(F.col("entity_id").alias("subject_id")), "subject_id", "left_semi")
    donors = gifts.select("subject_id").join(g.of("CONTRACTED_WITH").select("subject_id"), "subject_id", "left_semi")
    newest = g.statements.where("valid_from is not null").orderBy(F.desc("valid_from"), "statement_id").limit(1).join(g.named("subject"), "subject_id").join(g.named("object"), "object_id")
    count = F.count("*")
    return reduce(
        DataFrame.unionByName,
        [
            row(money, "total_political_money", F.col("v"), F.format_number("v", 0), F.col("n").cast("string"), F.col("d").cast("string")),
            row(top, "largest_single_donation", F.col("amount_gbp"), F.col("donor"), F.col("recipient")),
            row(paid.agg(F.count_distinct("subject_id").alias("v")), "parliamentarians_with_paid_ties", F.col("v")),
            row(donors.agg(F.count_distinct("subject_id").alias("v")), "donor_and_contractor_companies", F.col("v")),
            row(g.entities.agg(count.alias("v")), "entities_total", F.col("v")),
            row(g.statements.agg(count.alias("v")), "statements_total", F.col("v")),
            row(g.statements.select(F.explode("sources").alias("s")).agg(F.count_distinct("s").alias("v")), "registers_total", F.col("v")),
            row(newest, "newest_disclosure", F.lit(None), F.col("valid_from").cast("string"), F.col("subject"), F.col("statement_type"), F.col("object")),
        ],
    )
