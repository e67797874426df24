"""Landed register files drawn from the TPC-H-like tables, in the form that each source serves.

For queries, tests and benchmarks of the readers in ``registers``. Files that a reader
takes from disk (exports as CSV) are written to a new folder in the shared one first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch_dir, written
from . import registers
from .fixture import names, table

PREFIX = "landed"


def landed_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{PREFIX}-{label}-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, c, segment, person, price, day, priority): orders with their customers' names."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c"), F.col("p_name").alias("person"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_custkey c", "cast(floor(o_totalprice) as bigint) price", "cast(o_orderdate as date) day", "o_orderpriority priority")
    return o.join(customer, "c").join(part, "c")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company profiles with officers and persons of control."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("day", F.col("l_shipdate").cast("date"))
    officers = lines.where("l_linenumber % 2 = 1").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.expr("""collect_list(named_struct('name', p_name, 'officer_role', if(l_partkey % 50 = 0, 'corporate-director', 'director'), 'appointed_on', day,
            'resigned_on', if(l_returnflag = 'R', date_add(day, 400), null), 'nationality', 'British', 'country_of_residence', if(l_partkey % 3 = 0, 'England', 'Malta'),
            'link', concat('/officers/', l_partkey), 'identified', l_partkey % 70 = 0, 'date_of_birth', named_struct('month', 1, 'year', 1930 + cast(p_size as int))))""").alias("officers")
    )
    holders = lines.where("l_linenumber % 2 = 0").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.expr("""collect_list(named_struct('kind', if(l_partkey % 3 = 0, 'corporate-entity-person-with-significant-control', 'individual-person-with-significant-control'),
            'name', if(l_partkey % 11 = 0, null, p_name), 'notified_on', day, 'ceased_on', cast(null as date), 'nationality', 'British', 'country', 'England',
            'registration_number', if(l_partkey % 3 = 0, cast(l_partkey as string), null), 'date_of_birth', named_struct('month', 1, 'year', 1930 + cast(p_size as int))))""").alias("pscs")
    )
    own = names(spark, sf_dir).companies.selectExpr("id", "lpad(cast(id as string), 8, '0') company_number", "raw_name company_name", "if(id % 5 = 0, 'dissolved', 'active') company_status")
    return own.join(officers, "id", "left").join(holders, "id", "left").drop("id")


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donations as the public export has them, written as CSV and read by the reader."""
    rows = _orders(spark, sf_dir).selectExpr(
        "concat('R', k) ECRef", "if(k % 17 = 0, null, concat('Party ', k % 5)) RegulatedEntityName", "if(k % 2 = 0, 'Political Party', 'Regulated Donee') RegulatedEntityType",
        "if(k % 9 = 0, null, concat('£', format_number(price, 0), '.50')) Value", "case k % 3 when 0 then date_format(day, 'dd/MM/yyyy') when 1 then date_format(day, \"yyyy-MM-dd'T'00:00:00\") end AcceptedDate",
        "if(k % 13 = 0, null, person) DonorName", "element_at(array('Individual', 'Company', 'Registered Political Party', 'Trade Union'), cast(k % 4 + 1 as int)) DonorStatus",
        "if(k % 4 = 1, cast(c as string), null) CompanyRegistrationNumber", "if(k % 5 = 0, null, cast(c as string)) DonorId", "if(k % 3 = 0, null, cast(k % 5 as string)) RegulatedEntityId",
        "if(k % 3 = 2, date_format(day, 'dd/MM/yyyy'), null) ReportedDate", "'not wanted' Extra",
    )
    path = landed_path(spark, "donations")
    rows.write.option("header", True).csv(path)
    return registers.donations_csv(spark, path)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).where("segment = 'BUILDING'")
    posts = o.where("k % 7 = 0").groupBy("c").agg(F.expr("collect_list(named_struct('name', priority, 'start', day, 'end', cast(null as date)))").alias("posts"))
    seats = o.where("k % 7 in (1, 2)").groupBy("c").agg(F.expr("collect_list(named_struct('name', concat('Committee ', k % 12), 'role', if(k % 7 = 1, 'Vice-Chair', null), 'start', day, 'end', cast(null as date)))").alias("committees"))
    own = o.select("c", "person").distinct().selectExpr("c", "cast(c as string) id", "person name", "if(c % 9 = 0, null, concat('Party ', c % 5)) party", "cast(null as date) party_from")
    return own.join(posts, "c", "left").join(seats, "c", "left").drop("c")


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared interests: holdings (with a field there twice), payers, gifts, and ones that name nobody."""
    fields = """case k % 4
        when 0 then array(named_struct('name', 'OrganisationName', 'value', 'Old'), named_struct('name', 'OrganisationName', 'value', concat(' Org ', k % 50, ' Ltd')), named_struct('name', 'OrganisationDescription', 'value', 'housing'))
        when 1 then array(named_struct('name', 'PayerName', 'value', concat('Payer ', k % 30, if(k % 3 = 0, ' plc', ''))), named_struct('name', 'IsPaidAsDirectorOfPayer', 'value', if(k % 8 = 1, 'True', null)),
            named_struct('name', 'Value', 'value', concat('£', k)), named_struct('name', 'PayerIsPrivateIndividual', 'value', if(k % 12 = 5, 'true', null)), named_struct('name', 'PayerNatureOfBusiness', 'value', 'media'))
        when 2 then array(named_struct('name', 'DonationSource', 'value', 's'), named_struct('name', 'Value', 'value', '500'))
        else array(named_struct('name', 'Other', 'value', 'x')) end fields"""
    own = _orders(spark, sf_dir).where("segment = 'BUILDING'")
    return own.selectExpr("cast(c as string) member_id", "person member", "concat('Giver ', k % 20, if(k % 6 = 2, ' – £500', ' - 500')) summary", "day registered", fields)


def lords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows for each lord, in two chains of parents and children; every eleventh is deleted."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey k")
    text = """case when k % 4 = 0 then concat('Director, Estate ', k % 25, ' Limited (farming)') when k % 4 = 2 then concat('Adviser,  Bureau ', k % 25)
        when k % 4 = 1 then concat('100 per cent of shares of Land ', k % 25, ' Ltd (UK) (property)') else 'various shares' end interest"""
    return o.selectExpr(
        "cast(k div 10 as string) member_id", "concat('Lord ', k div 10) member", "if(k % 10 < 2, cast(k % 10 + 1 as int), null) category", "cast(k as string) interest_id",
        "if(k % 10 < 2, null, cast(k - 2 as string)) parent_id", text, "k % 11 = 0 deleted",
    )


def contract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, company_number) of known companies; every tenth has a namesake of another legal form."""
    s = table(spark, sf_dir, "supplier")
    own = s.selectExpr("concat(s_name, ' Limited') name", "lpad(cast(s_suppkey as string), 8, '0') company_number")
    return own.unionByName(s.where("s_suppkey % 10 = 0").selectExpr("concat(s_name, ' PLC') name", "concat('X', s_suppkey) company_number"))


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("day", F.col("l_shipdate").cast("date"))
    return lines.selectExpr(
        "concat('n', l_orderkey) notice_id", "'t' title", "if(l_partkey % 23 = 0, null, concat('Council ', l_orderkey % 20)) buyer", "concat(s_name, if(l_partkey % 2 = 0, ' Ltd.', ' L&#116;d')) supplier",
        "if(l_linenumber = 7, '0', concat('£', cast(floor(l_extendedprice) as bigint))) value", "if(l_linenumber % 2 = 0, day, null) awarded", "date_add(day, 1) start", "date_add(day, 365) end",
    )


def group_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of HTML for each nation: a group with officers (customers) and benefits (suppliers)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    people = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").join(part, F.col("c_custkey") == F.col("p_partkey"))
    rows = people.groupBy(F.col("c_nationkey").alias("n")).agg(F.expr("array_join(collect_list(concat('<tr><td>', if(c_custkey % 50 = 0, 'Chair &amp; Registered Contact', 'Officer'), '</td><td><b>', p_name, '</b></td><td>Party</td></tr>')), '')").alias("officers"))
    gifts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(
        F.expr("array_join(collect_list(concat('<tr><td>', s_name, ' Ltd</td><td>£', format_number(cast(floor(s_acctbal) as bigint), 0), '</td><td>0', 1 + s_suppkey % 9, '/02/2020 to date</td><td>x</td></tr>')), '')").alias("gifts")
    )
    page = """concat('<html><table><tr><td>Title</td><td>Group of ', n_name, ' &amp; Friends</td></tr><tr><td>Purpose</td><td>x</td></tr></table>',
        '<table class="x"><tr><td>Officers</td></tr><tr><td>Role</td><td>Name</td><td>Party</td></tr>', coalesce(officers, ''),
        '</table><p>text</p><table><tr><td>a</td><td>9999</td><td>01/02/2020</td><td>d</td></tr><tr><td>Financial Benefits</td></tr><tr><td>Source</td><td>Value £s</td><td>Received</td><td>Registered</td></tr>',
        coalesce(gifts, ''), '<tr><td>Benefits in kind</td></tr><tr><td>late</td><td>9999</td><td>01/02/2020</td><td>d</td></tr></table></html>') html"""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "n")
    return nation.join(rows, "n", "left").join(gifts, "n", "left").selectExpr("n page_id", page)


def group_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, body): contents pages of editions, of which the newest did not come."""
    nation = table(spark, sf_dir, "nation").agg(F.expr("array_join(transform(sort_array(collect_list(named_struct('n', n_nationkey, 'name', n_name))), x -> concat('<li><a href=\"group-', x.n, '.htm\">', x.name, ' &amp; Co </a></li>')), '')").alias("links"))
    body = "concat('<h1>Register Of All-Party Parliamentary Groups</h1><a href=\"introduction.htm\">Introduction</a>', links) body"
    return nation.selectExpr("explode(array('010801', '010620', '260518')) key", body).withColumn("body", F.when(F.col("key") != "010801", F.col("body")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, body): answers of a news search for persons; some failed, some can't be read."""
    found = "to_json(named_struct('articles', sort_array(collect_list(named_struct('url', concat('https://news.test/', k), 'title', concat('T', k), 'domain', 'news.test', 'seendate', cast(day as string))))))"
    own = _orders(spark, sf_dir).groupBy("c").agg(F.expr(found).alias("body"))
    return own.selectExpr("concat('P', c) key", "case when c % 5 = 0 then null when c % 7 = 0 then '<html>busy' else body end body")


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of leaked registers, written as CSV and read by the reader."""
    own = names(spark, sf_dir).companies.selectExpr(
        "concat('n', id) node_id", "if(id % 13 = 0, null, upper(raw_name)) name", "'SAM' jurisdiction", "if(id % 4 = 0, null, 'Samoa') jurisdiction_description", "if(id % 7 = 0, 'Malta Corporate Registry', 'Papers') sourceID",
    )
    path = landed_path(spark, "leaked")
    own.write.option("header", True).csv(path)
    return registers.leaked_csv(spark, path)


def own_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, entity_type, name) of companies, by their written names."""
    return names(spark, sf_dir).companies.selectExpr("concat('C', id) entity_id", "'company' entity_type", "raw_name name")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, url, title, domain, seendate): news that a search found for persons; some found twice."""
    return _orders(spark, sf_dir).selectExpr("concat('P', c) entity_id", "concat('https://news.test/', k % 400) url", "concat('T', k) title", "'news.test' domain", "date_format(day, \"yyyyMMdd'T'HHmmss'Z'\") seendate")


def everything(spark: SparkSession, sf_dir: str) -> registers.Landed:
    """All landed registers together. What a reader takes is written once, as mentions and ties are read from it apart."""
    own = lambda make: written(make(spark, sf_dir))
    out = registers.companies(own(companies)).union(registers.donations(own(donations))).union(registers.members(own(members)))
    out = out.union(registers.interests(own(interests))).union(registers.lords(own(lords)))
    return out.union(registers.contracts(own(awards), own(contract_names))).union(registers.groups_html(own(group_pages)))
