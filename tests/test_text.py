import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieweave.functions import text


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in df.select("i", column(F.col("x"))).orderBy("i").collect()]


def test_adjacent_titles_share_a_blank(spark):
    assert values(spark, text.person_key, "Rt Hon Sir Keir Able", "Mr Tom Cowling", "COWLING, Tom", "", None) == ["able hon keir", "cowling tom", "cowling tom", "", ""]
    assert values(spark, text.person_token_key, "Rt Hon Sir Keir Able") == ["able keir"]


def test_legal_forms(spark):
    assert values(spark, text.organisation_key, "The Acme Ltd", "Acme Holdings plc") == ["acme", "acme holdings"]
    assert values(spark, text.suffix_class, "Acme Ltd", "Acme Inc.", "Acme LP", "Acme") == ["ltd", "foreign", "lp", "none"]
    assert values(spark, text.company_base, "The Acme Company Ltd") == ["acme"]


def test_money(spark):
    assert values(spark, text.money, "£1,200.50", "", "n/a", None) == [Decimal("1200.50"), Decimal("0.00"), None, None]
    assert values(spark, text.declared_money, "", "£7") == [None, Decimal("7.00")]
    assert values(spark, text.contract_money, "0", "-3", "4") == [None, None, Decimal("4.00")]
    assert values(spark, text.short_money, "£1.5m", "20k", "£2bn", "7") == [1.5e6, 2e4, 2e9, 7.0]


def test_dates(spark):
    assert values(spark, text.register_date, "31/12/2020", "2020-12-31T10:00:00", "soon") == [datetime.date(2020, 12, 31)] * 2 + [None]
    assert values(spark, text.seen_date, "20200131T100000Z", "soon") == ["2020-01-31", "soon"]


@pytest.mark.parametrize(
    ("line", "left"),
    [("Acme Ltd (software)", "Acme Ltd"), ("Acme (UK)", "Acme (UK)"), ("Acme Ltd (a) (see (b))", "Acme Ltd"), ("open (a", "open (a"), ("", "")],
)
def test_trailing_descriptions(line, left):
    assert text.without_descriptions(line) == left


def test_employment_takes_the_last_comma(spark):
    role, org = text.employment(F.lit("Co-chair, Founder and Director, Visio Limited (big, known)"))
    assert spark.range(1).select(role, org).first() == ("Co-chair, Founder and Director", "Visio Limited")


def test_search_key_stops_at_generic_words(spark):
    assert values(spark, lambda x: text.search_key(text.supplier_name(x)), "Ecotrix Group Limited", "Group One", "A & B Capital") == ["ecotrix", "group one", "a and b"]


def test_entities_without_a_semicolon_stay(spark):
    assert values(spark, text.closed_entities, "a &amp; b&lt;&gt;&quot;", "cut &amp", "&amp;lt;", "&eacute;", "", None) == ['a & b<>"', "cut &amp", "&lt;", "&eacute;", "", None]
