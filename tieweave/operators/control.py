"""Control through chains of holdings, and what stands under common control.

``control`` is the rule "who holds much of a company controls what it holds much of", run
to its fixed point. A chain's share is the product of its holdings; of all chains between two entities
the best counts. Each round joins only what the round before made better (the delta) with the
holdings, and writes only that; the tables of earlier rounds are read, never written again.
As no share is above one, going round a cycle makes nothing better, so rounds end; and chains below
``least`` end there.

``common_control`` gives what one controller controls as a membership list and pairs of each
member with the controller's first member: as many rows as there are members, never all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

LEAST = 0.25
#: Controllers with more than one in so many memberships are joined by broadcast; there are at most as many.
HOT_CONTROLLERS = 1_000


def holdings(statements: DataFrame, conductance: DataFrame, types: tuple[str, ...] = ("OWNS", "PSC_OF")) -> DataFrame:
    """(owner_id, owned_id, share) of statements: confidence times conductance of the type. conductance: (statement_type, conductance)."""
    own = statements.where(F.col("statement_type").isin(*types)).join(F.broadcast(conductance), "statement_type")  # a fixed lookup table
    return own.groupBy(F.col("subject_id").alias("owner_id"), F.col("object_id").alias("owned_id")).agg(F.max(F.col("confidence") * F.col("conductance")).alias("share"))


def control(held: DataFrame, least: float = LEAST) -> DataFrame:
    """(controller_id, company_id, share, steps): the best chain's share from ``least`` on, and the fewest steps of the chains that have it.

    held: (owner_id, owned_id, share), shares in (0, 1]; rows that repeat count once, with the
    best share. Rows with a null, with one entity on both sides or a share of ``least`` at most 0 don't count;
    shares above 1 count as 1. Nobody controls itself, whatever cycles there are.
    """
    sound = held.where("owner_id is not null and owned_id is not null and owner_id != owned_id and share > 0")
    base = checkpointed(sound.groupBy("owner_id", "owned_id").agg(F.least(F.max("share"), F.lit(1.0)).alias("share")).where(F.col("share") >= least))
    delta = base.select(F.col("owner_id").alias("controller_id"), F.col("owned_id").alias("company_id"), "share", F.lit(1).alias("steps"))
    rounds = [checkpointed(delta)]
    step = base.select(F.col("owner_id").alias("company_id"), F.col("owned_id").alias("next_id"), F.col("share").alias("own"))
    while not rounds[-1].isEmpty():
        longer = rounds[-1].join(step, "company_id").where("controller_id != next_id").select("controller_id", F.col("next_id").alias("company_id"), (F.col("share") * F.col("own")).alias("share"), F.col("steps") + 1)
        longer = longer.toDF("controller_id", "company_id", "share", "steps").where(F.col("share") >= least)
        new = _best(longer)
        known = _best(reduce(DataFrame.unionByName, rounds)).select("controller_id", "company_id", F.col("share").alias("old"))
        rounds.append(checkpointed(new.join(known, ["controller_id", "company_id"], "left").where("old is null or share > old").drop("old")))
    return _best(reduce(DataFrame.unionByName, rounds))


def _best(chains: DataFrame) -> DataFrame:
    """One row for each controller and company: the best share, the fewest steps."""
    best = F.min(F.struct((-F.col("share")).alias("less"), "steps"))
    own = chains.groupBy("controller_id", "company_id").agg(best.alias("b"))
    return own.select("controller_id", "company_id", (-F.col("b.less")).alias("share"), F.col("b.steps").alias("steps"))


def common_control(controlled: DataFrame) -> DataFrame:
    """(controller_id, company_id, share, first_id, first_share, n_members) of what ``control`` gives, of controllers with two companies or more.

    first is the controller's company with the best share (then the least id). Two companies
    are related through a controller if both are its members, so the list is the whole relation.
    """
    written = checkpointed(controlled)
    first = F.min(F.struct((-F.col("share")).alias("less"), F.col("company_id").alias("first_id")))
    own = written.groupBy("controller_id").agg(first.alias("f"), F.count("*").alias("n_members")).where("n_members > 1")
    own = checkpointed(own.select("controller_id", "f.first_id", (-F.col("f.less")).alias("first_share"), "n_members"))
    hot = F.col("n_members") > F.lit(max(1, written.count() // HOT_CONTROLLERS))
    # At most HOT_CONTROLLERS controllers can have more than one in HOT_CONTROLLERS of all rows.
    in_hot = written.join(F.broadcast(own.where(hot)), "controller_id")
    in_cold = written.join(F.broadcast(own.where(hot).select("controller_id")), "controller_id", "left_anti").join(own.where(~hot), "controller_id")
    return in_hot.unionByName(in_cold).select("controller_id", "company_id", "share", "first_id", "first_share", "n_members")


def related(members: DataFrame) -> DataFrame:
    """(first_id, company_id, n_controllers, confidence): each member beside its controller's first, over all controllers.

    confidence is a noisy-or over controllers of the product of both shares.
    """
    pairs = members.where("first_id != company_id")
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("share") * F.col("first_share"), F.lit(1e-12)))))
    return pairs.groupBy("first_id", "company_id").agg(F.count("*").alias("n_controllers"), (1 - doubt).alias("confidence"))


def related_to(members: DataFrame, company_id: str) -> DataFrame:
    """(company_id, n_controllers, confidence) of all companies under common control with one, the most confident first."""
    own = members.where(F.col("company_id") == company_id).select("controller_id", F.col("share").alias("own"))
    others = members.where(F.col("company_id") != company_id).join(own, "controller_id")
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("share") * F.col("own"), F.lit(1e-12)))))
    found = others.groupBy("company_id").agg(F.count("*").alias("n_controllers"), (1 - doubt).alias("confidence"))
    return found.orderBy(F.desc("confidence"), "company_id")


def ultimate(controlled: DataFrame) -> DataFrame:
    """(company_id, controller_id, share, steps): of each company the controllers that nobody controls, best first by ``place``."""
    top = controlled.join(controlled.select(F.col("company_id").alias("controller_id")).distinct(), "controller_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("share"), "controller_id"))
    return top.withColumn("place", place).select("company_id", "controller_id", "share", "steps", "place")
