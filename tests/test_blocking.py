"""Name keys and similarity against plain versions and DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tieweave.checkpoints import checkpointed
from tieweave.operators import blocking

MENTIONS = "mention_id string, raw_name string, birth_year string"


def test_similarity_equals_duckdb(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
    rows = [(word(), word()) for _ in range(1500)] + [("martha", "marhta"), ("dixon", "dicksonx"), ("a", "b"), ("a", "a"), ("ab", "ba")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select("a", "b", F.round(blocking.jaro_winkler(F.col("a"), F.col("b")), 6)).collect()
    con = duckdb.connect()
    for a, b, s in found:
        assert s == pytest.approx(con.execute("SELECT round(jaro_winkler_similarity(?, ?), 6)", [a, b]).fetchone()[0], abs=2e-6), (a, b)


@pytest.mark.parametrize(("a", "b"), [("Philips", "Filips"), ("Knight", "Night"), ("Wright", "Rite"), ("Smith", "Smyth"), ("Catherine", "Katherine"), ("Müller", "Muller"), ("Ann", "An")])
def test_one_sound(spark, a, b):
    x, y = spark.range(1).select(blocking.sound(F.lit(a)), blocking.sound(F.lit(b))).first()
    assert x == y


def test_sounds_that_differ(spark):
    words = ["Smith", "Jones", "Baker", "Parr", "Otto", "Bob", "Foster", ""]
    found = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(blocking.sound(F.col("w"))).collect()]
    assert len(set(found)) == len(words)


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice(["ka", "ca", "ph", "fi", "to", "do"]) for _ in range(2)) for _ in range(30)]
    rows = [(f"m{i:03}", f"{rng.choice(['jo', 'jan', 'kim'])} {rng.choice(names)}", rng.choice([None, "1950", "1951"])) for i in range(120)]
    member = blocking.members(spark.createDataFrame(rows, MENTIONS))
    form = blocking.forms(member)
    known = {r["form_id"]: (r["surname"], r["forenames"], r["birth_year"]) for r in form.collect()}
    heard = {r[0]: r[1] for r in form.select("surname", blocking.sound(F.col("surname"))).collect()}

    def keys(form):
        surname, forenames, year = form
        whole = f"{forenames} {surname}"
        own = {("edit", whole)} | {("edit", whole[:i] + whole[i + 1 :]) for i in range(len(whole))}
        return own | {("initial", heard[surname], forenames[0])} | ({("year", heard[surname], year)} if year else set())

    expected = {}
    for a, x in known.items():
        for b, y in known.items():
            if a < b and (kinds := {k[0] for k in keys(x) & keys(y)}):
                expected[a, b] = ",".join(k for k in blocking.KINDS if k in kinds)
    found = blocking.candidates(form).collect()
    assert len(found) == len(expected)
    assert {(r["a"], r["b"]): r["met_by"] for r in found} == expected


def test_a_name_of_a_third_is_one_form(spark):
    rows = [(f"h{i:04}", "John Smith", "1950") for i in range(1000)] + [(f"o{i:04}", f"Jon Smith{'abcdefghij'[i % 10]}", None) for i in range(2000)]
    member = blocking.members(spark.createDataFrame(rows, MENTIONS))
    form = blocking.forms(member)
    assert member.count() == 3000 and form.count() == 11
    assert form.agg(F.max("n_mentions")).first()[0] == 1000
    assert blocking.candidates(form).count() <= 55


def test_odd_names(spark):
    rows = [("a", None, None), ("b", "", "1950"), ("c", "123", None), ("d", "Dr", None), ("e", "Plato", "1950"), ("f", "Platto", "1950"), ("g", "Plato", None), ("e2", "Plato", "1950"), ("x", "Z" * 900, None)]
    mentions = spark.createDataFrame(rows, MENTIONS).withColumn("surname", F.lit("clash"))
    member = blocking.members(mentions)
    assert {r["mention_id"] for r in member.collect()} == {"e", "f", "g", "e2", "x"}
    found = blocking.verified(blocking.candidates(blocking.forms(member))).collect()
    # One name alone needs the same year on both sides.
    assert [(sorted([r["surname_a"], r["surname_b"]]), r["forename_similarity"]) for r in found] == [(["plato", "platto"], None)]
    none = blocking.members(mentions.limit(0))
    assert blocking.verified(blocking.candidates(blocking.forms(none))).count() == 0
    assert blocking.recall(spark.createDataFrame([], "left_id string, right_id string"), none, blocking.candidates(blocking.forms(none))).count() == 4


def test_forms_by_key_are_not_broadcast(spark):
    """Forms look small to the optimizer, but each is a row for every key, with all keys."""
    member = blocking.members(spark.createDataFrame([("a", "Jo Baker", "1950"), ("b", "Jo Backer", None)], MENTIONS))
    plan = blocking.candidates(checkpointed(blocking.forms(member)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_dated_candidates_are_those_whose_years_do_not_differ(spark):
    """Years are compared before keys are."""
    rng = random.Random(7)
    rows = [(f"m{i:03}", f"{rng.choice(['jo', 'jan', 'kim', ''])} {rng.choice(['kato', 'cato', 'phido', 'fido', 'toka', 'dofi'])}", rng.choice([None, "", "1950", "1951"])) for i in range(150)]
    form = checkpointed(blocking.forms(blocking.members(spark.createDataFrame(rows, MENTIONS))))
    every, found = blocking.candidates(form), blocking.candidates(form, dated=True)
    assert found.columns == every.columns
    alike = every.where("coalesce(birth_year_a = birth_year_b, true)")
    assert sorted(map(str, found.collect())) == sorted(map(str, alike.collect()))
    assert 0 < found.count() < every.count()
    plan = blocking.verified(found)._jdf.queryExecution().optimizedPlan().toString()
    (join,) = [line for line in plan.splitlines() if "Join Inner" in line]
    assert 0 < join.index("birth_year_a") < join.index("array_intersect")
