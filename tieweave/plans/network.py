"""Registered queries over the whole network: paths, control, centrality, and alerts from its stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..checkpoints import checkpointed
from ..operators import centrality, control, paths
from ..operators.findings import Graph
from ..sources import fixture, landing
from ..streaming import alerts, ingest

RANK_ROUNDS = 10
N_PIVOTS = 8
LOOP_DAYS = 20
#: Files of one year's ties.
FILES = 4


def wanted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start_id, goal_id): every fiftieth person with the next one, and with a party."""
    k = F.col("c_custkey")
    person = lambda key: F.concat(F.lit("P"), key.cast("string"))
    goals = F.explode(F.array(person(k + 1), F.concat(F.lit("R"), (k % 5).cast("string"))))
    return fixture.table(spark, sf_dir, "customer").where(k % 50 == 0).select(person(k).alias("start_id"), goals.alias("goal_id"))


def company_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, owned_id, share): the company of an order's first large line holds a part of that of the second."""
    line = lambda n: fixture.table(spark, sf_dir, "lineitem").where(f"l_linenumber = {n} and l_quantity >= 49")
    first = line(1).select("l_orderkey", F.col("l_suppkey").alias("owner"))
    second = line(2).select("l_orderkey", F.col("l_suppkey").alias("owned"), F.round(F.least(F.lit(1.0), 0.4 + 6 * F.col("l_discount")), 2).alias("share"))
    key = lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    return first.join(second, "l_orderkey").select(key("owner").alias("owner_id"), key("owned").alias("owned_id"), "share")


def company_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gifts and contracts of companies, as a stream gets them."""
    own = fixture.ties(spark, sf_dir).where(F.col("statement_type").isin(alerts.GIFT, alerts.CONTRACT) & F.col("from_id").startswith("C"))
    key = F.md5(F.concat_ws("|", "statement_type", "from_id", "to_id", F.col("valid_from").cast("string"), F.col("amount_gbp").cast("string")))
    return own.select(key.alias("tie_id"), F.col("from_id").alias("company_id"), F.col("statement_type").alias("kind"), F.col("valid_from").cast("timestamp").alias("at"))


def loop_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over the ties, landed year by year, tells of companies whose gift and contract are near."""
    own = checkpointed(company_ties(spark, sf_dir))
    path, out = landing.landed_path(spark, "ties"), landing.landed_path(spark, "alerts")
    for (year,) in own.select(F.year("at")).distinct().orderBy(F.year("at")).collect():  # a few
        own.where(F.year("at") == year).repartition(FILES, "company_id").write.parquet(f"{path}/{year}")
    # A company's ties of one year lie in one file. Files of two years may be one batch, so rows are up to a year late.
    stream = alerts.closing_loops(alerts.landed(spark, path, FILES), late="800 days", expiry_days=LOOP_DAYS)
    ingest.into(stream, out, landing.landed_path(spark, "alerts-state")).awaitTermination()
    return spark.read.schema(alerts.ALERTS).option("recursiveFileLookup", True).parquet(out).withColumn("closed_at", F.col("closed_at").cast("date"))


def queries(graph: Callable[[SparkSession, str], Graph]) -> dict[str, Callable]:
    def best(s: SparkSession, d: str) -> DataFrame:
        return paths.best_paths(graph(s, d), wanted_pairs(s, d))

    def best_rows(s: SparkSession, d: str) -> DataFrame:
        return best(s, d).select(
            "start_id", "goal_id", "place", F.array_join("path", ">").alias("path"), F.array_join("statement_ids", ",").alias("statement_ids"),
            F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.array_join("sources", ",").alias("sources"),
        )

    def connected(s: SparkSession, d: str) -> DataFrame:
        found = paths.connections(best(s, d))
        return found.select("start_id", "goal_id", "n_paths", "n_independent", *(F.round(c, 6).alias(c) for c in ("best", "confidence", "strength")))

    def controlled(s: SparkSession, d: str) -> DataFrame:
        own = control.holdings(graph(s, d).statements, schemas.statement_types(s).select("statement_type", "conductance"))
        return control.control(own.unionByName(company_holdings(s, d)))

    def shares(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.round(c, 6) for c in df.columns if c in ("share", "first_share", "confidence")})

    def members(s: SparkSession, d: str) -> DataFrame:
        return control.common_control(controlled(s, d))

    def ranks(s: SparkSession, d: str) -> DataFrame:
        g = graph(s, d)
        found = centrality.pagerank(g.entities, centrality.weighted(g), tolerance=0, rounds=RANK_ROUNDS)
        return found.select("entity_id", F.round("rank", 9).alias("rank"))

    def between(s: SparkSession, d: str) -> DataFrame:
        g = graph(s, d)
        hubs = checkpointed(g.hubs)
        edges = centrality.weighted(g).join(hubs.withColumnRenamed("entity_id", "a"), "a", "left_anti").join(hubs.withColumnRenamed("entity_id", "b"), "b", "left_anti")
        people = g.entities.where("entity_type = 'person'")
        found = centrality.betweenness(edges, centrality.pivots(people, N_PIVOTS))
        return found.select("entity_id", F.round("betweenness", 6).alias("betweenness"))

    return {
        "path_best": best_rows,
        "path_connections": connected,
        "control_chains": lambda s, d: shares(controlled(s, d)),
        "control_common": lambda s, d: shares(members(s, d)),
        "control_related": lambda s, d: shares(control.related(members(s, d))),
        "control_ultimate": lambda s, d: shares(control.ultimate(checkpointed(controlled(s, d)))),
        "centrality_pagerank": ranks,
        "centrality_betweenness": between,
        "stream_loop_alerts": loop_alerts,
    }
