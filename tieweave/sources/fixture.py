"""A relationship graph drawn from the TPC-H-like tables, for queries, tests and benchmarks.

Customers are persons (named like the part of the same number, so that homonyms and
surnames occur), suppliers are companies, nations are government bodies, regions are
parties, and each second word of a part's name is a committee.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import Raw

AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    person = table(spark, sf_dir, "customer").join(part, F.col("c_custkey") == F.col("p_partkey"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, key: str, kind: str, name: Column, category: Column = none, jurisdiction: Column = none) -> DataFrame:
        columns = [F.concat(F.lit(key[0]), F.col(key[2:]).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type")]
        return df.select(*columns, name.alias("name"), category.alias("category"), jurisdiction.alias("jurisdiction"))

    abroad = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).otherwise("GB")
    nouns = part.select(F.split("p_name", " ")[1].alias("noun")).distinct()
    return (
        rows(person, "P:c_custkey", "person", F.col("p_name"), F.when(F.col("c_mktsegment") == "BUILDING", "mp"), abroad)
        .unionByName(rows(table(spark, sf_dir, "supplier"), "C:s_suppkey", "company", F.col("s_name"), F.lit("company"), F.lit("GB")))
        .unionByName(rows(nation, "G:n_nationkey", "government_body", F.col("n_name")))
        .unionByName(rows(region, "R:r_regionkey", "party", F.col("r_name"), F.lit("party")))
        .unionByName(rows(nouns, "O:noun", "organisation", F.concat(F.lit("Committee for "), "noun")))
    )


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_type, source_code, from_id, to_id, valid_from, valid_to, amount_gbp) between entities.

    One scan and one join chain give all kinds of ties: each order line is turned into
    the ties that it stands for.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_regionkey", "c_region").drop("n_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    supplier = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_regionkey", "s_region")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[1].alias("noun"))
    base = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    ordered, shipped = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    no_date, no_money = F.lit(None).cast("date"), F.lit(None).cast("decimal(18,2)")

    def key(letter: str, column: str) -> Column:
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    def tie(kind, source, a: Column, b: Column, begin: Column, end: Column, amount: Column) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            lit(kind).alias("statement_type"), lit(source).alias("source_code"), a.alias("from_id"), b.alias("to_id"),
            begin.alias("valid_from"), end.alias("valid_to"), amount.alias("amount_gbp"),
        )

    person, company = key("P", "c_custkey"), key("C", "s_suppkey")
    role = F.when(F.col("l_linenumber") % 2 == 1, "DIRECTOR_OF").otherwise("OWNS")
    register = F.when(F.col("o_orderstatus") == "F", "companies_house").otherwise("parliament_interests")
    quantity = F.col("l_quantity")
    found = F.array(
        tie("DONATED_TO", "electoral_commission", person, key("R", "s_region"), ordered, no_date, money("o_totalprice")),
        F.when(quantity >= 48, tie("DONATED_TO", "electoral_commission", company, key("R", "c_region"), shipped, no_date, money("l_extendedprice"))),
        F.when((quantity >= 49) & (F.col("l_linestatus") == "O"), tie("CONTRACTED_WITH", "contracts_finder", company, key("G", "c_nationkey"), ordered, shipped, money("l_extendedprice"))),
        F.when(F.col("l_returnflag") == "R", tie(role, register, person, company, ordered, shipped, no_money)),
        F.when((quantity >= 49) & (F.col("c_mktsegment") == "BUILDING"), tie("MEMBER_OF", "parliament", person, key("O", "noun"), no_date, no_date, no_money)),
    )
    lines = base.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("t")).select("t.*")
    return lines.unionByName(customer.select(tie("MEMBER_OF", "parliament", person, key("R", "c_region"), no_date, no_date, no_money).alias("t")).select("t.*"))


def raw(spark: SparkSession, sf_dir: str) -> Raw:
    """The raw layer: one mention for each source and entity, and each tie as an assertion.

    Every seventh person is mentioned with a confidence of 0.7, every 31st with 0.45.
    """
    between = ties(spark, sf_dir)
    mention = lambda c: F.concat_ws(":", "source_code", c)
    assertions = between.select(
        F.md5(F.concat_ws("|", "statement_type", "source_code", "from_id", "to_id", F.coalesce(F.col("valid_from").cast("string"), F.lit("")), F.coalesce(F.col("valid_to").cast("string"), F.lit("")), F.coalesce(F.col("amount_gbp").cast("string"), F.lit("")))).alias("assertion_id"),
        "statement_type", "source_code", mention("from_id").alias("from_mention_id"), mention("to_id").alias("to_mention_id"), "valid_from", "valid_to", "amount_gbp",
    )
    number = F.substring("entity_id", 2, 20).try_cast("bigint")
    confidence = F.when((F.substring("entity_id", 1, 1) == "P") & (number % 31 == 0), 0.45).when((F.substring("entity_id", 1, 1) == "P") & (number % 7 == 0), 0.7).otherwise(1.0)
    ends = between.select("source_code", F.col("from_id").alias("entity_id")).unionByName(between.select("source_code", F.col("to_id").alias("entity_id")))
    resolutions = ends.distinct().select(mention("entity_id").alias("mention_id"), "entity_id", confidence.alias("match_confidence"))
    return Raw(assertions, resolutions, entities(spark, sf_dir))


@dataclass(frozen=True)
class Names:
    """Names with titles, legal forms and commas, made of part and supplier names."""

    people: DataFrame
    companies: DataFrame


def names(spark: SparkSession, sf_dir: str) -> Names:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    k = F.col("p_partkey") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("Rt Hon Sir "), "p_name")).when(k == 1, F.concat(F.lit("Dr. "), "p_name"))
        .when(k == 2, F.concat(F.upper(F.split("p_name", " ")[1]), F.lit(", "), F.split("p_name", " ")[0]))
        .when(k == 3, F.concat(F.col("p_name"), F.lit(" O'Brien MP"))).otherwise(F.col("p_name"))
    )
    people = part.select(F.col("p_partkey").alias("id"), name.alias("raw_name"))
    j = F.col("s_suppkey") % 7
    form = F.when(j == 0, " Limited").when(j == 1, " plc").when(j == 2, " LLP").when(j == 3, " Inc.").when(j == 4, " & Co Ltd").when(j == 5, " Group Holdings UK").otherwise("")
    return Names(people, supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("The "), "s_name", form).alias("raw_name")))


# Parts that the names below are put together from.
SURNAME_PARTS = "ba ker tin mor phil son gar ley wood ches ter ham vic stone quin dale".split()
FORENAME_BEGINNINGS = "an jo mar el ste da ro li vi phi ca ge wi ha su ed".split()
FORENAME_ENDINGS = "na hn ry la ven vid bert sa ctor lip rol orge liam rold san win".split()


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, person_id, raw_name, birth_year): each customer by name, every third one also misspelt by another register.

    Names come from the digest of the key. A register drops, doubles or swaps letters or
    writes another one of the same sound; half of its rows lack the year.
    """
    k, digest = F.col("c_custkey"), F.md5(F.col("c_custkey").cast("string"))

    def part(parts: list[str], place: int) -> Column:
        return F.element_at(F.array(*map(F.lit, parts)), F.conv(F.substring(digest, place, 1), 16, 10).cast("int") + 1)

    surname = F.concat(part(SURNAME_PARTS, 1), part(SURNAME_PARTS, 2), part(SURNAME_PARTS, 3))
    forename = F.concat(part(FORENAME_BEGINNINGS, 4), part(FORENAME_ENDINGS, 5))
    own = table(spark, sf_dir, "customer").select(k.alias("k"), surname.alias("s"), forename.alias("f"))
    s, at = F.col("s"), 2 + F.col("k") % (F.length("s") - 2)
    cut = lambda a, n: F.substr(s, a, n)
    end = F.length(s)
    wrong = (
        F.when(F.col("k") % 4 == 0, F.concat(cut(F.lit(1), at - 1), cut(at + 1, end))).when(F.col("k") % 4 == 1, F.concat(cut(F.lit(1), at), cut(at, end)))
        .when(F.col("k") % 4 == 2, F.translate(F.replace(s, F.lit("ph"), F.lit("f")), "kvy", "cfi"))
        .otherwise(F.concat(cut(F.lit(1), at - 1), cut(at + 1, F.lit(1)), cut(at, F.lit(1)), cut(at + 2, end)))
    )
    year = (1940 + F.col("k") % 50).cast("string")
    row = lambda register, name, born: F.struct(
        F.concat(F.lit(f"{register}:"), F.col("k").cast("string")).alias("mention_id"), F.concat(F.lit("P"), F.col("k").cast("string")).alias("person_id"),
        name.alias("raw_name"), born.alias("birth_year"),
    )
    plain, misspelt = row("a", F.concat_ws(" ", "f", "s"), year), row("b", F.concat(F.upper(wrong), F.lit(", "), F.col("f")), F.when(F.col("k") % 2 == 0, year))
    rows = F.when(F.col("k") % 3 == 0, F.array(plain, misspelt)).otherwise(F.array(plain))
    return own.select(F.explode(rows).alias("x")).select("x.*")
