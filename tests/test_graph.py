import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tieweave.checkpoints import checkpointed
from tieweave.operators import attention, components, dedupe, edges, findings, insights, matcher, ranks, reads, sentences
from tieweave.operators.findings import Graph
from tieweave.plans import build, queries
from tieweave.sources import fixture, landing, sinks


@pytest.fixture(scope="module")
def g(spark, data):
    return queries.graph(spark, data)


def test_scores_are_shares_and_ties_no_loops(g):
    bad = g.statements.where("subject_id = object_id or strength < 0 or strength > 1 or confidence <= 0 or confidence > 1")
    assert bad.isEmpty()


def test_every_entity_has_an_insight(g):
    found = insights.insights(g, findings.findings(g, "BIG_MONEY", "SHARED_BENCH"))
    assert g.entities.join(found, "entity_id", "left_anti").isEmpty()
    assert found.groupBy("insight_id").count().where("count > 1").isEmpty()


def test_findings_are_unique_and_gated(g):
    found = findings.findings(g)
    assert found.groupBy("finding_id").count().where("count > 1").isEmpty()
    assert found.where("min_confidence < 0.5 or is_lead != (min_confidence < 0.8)").isEmpty()


def test_components_go_to_the_fixed_point(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    found = dict(components.connected_components(chain).collect())
    assert {found[i] for i in range(41)} == {0}
    assert {found[i] for i in (100, 101, 102)} == {100}
    assert components.connected_components(chain.limit(0)).isEmpty()


def test_rounds_of_components_do_not_swell_the_estimated_size(spark):
    """A path takes several rounds; an estimate that each of them multiplies has thousands of digits and fills the driver."""
    path = spark.range(3000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = components.connected_components(path)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
    assert found.count() == 3001 and found.select("root").distinct().count() == 1


def test_links_join_what_pairs_join(spark):
    """Of a group of n only n - 1 links are made; shared births and years count as in pairs."""
    entity = spark.createDataFrame([(f"P{i:02}", "person", "A B" if i < 40 else "C D") for i in range(60)] + [("C1", "company", "X"), ("C2", "company", "Y")], "entity_id string, entity_type string, name string")
    told = spark.createDataFrame([(f"P{i:02}", f"C{i % 2 + 1}") for i in range(50)], "subject_id string, object_id string")
    births = spark.createDataFrame([(f"P{i:02}", "1910" if i % 3 else f"1910-0{i % 2 + 1}") for i in range(36, 60, 2)], "entity_id string, dob string")
    for born in (None, births):
        pairs, links = (f(entity, told, born) for f in (dedupe.person_pairs, dedupe.person_links))
        assert sorted(dedupe.components(pairs).collect()) == sorted(dedupe.components(links).collect())
        assert links.count() <= 60 < 400 <= pairs.count()


def test_merging_again_changes_nothing(spark, data):
    raw, replaced = build.merged(fixture.raw(spark, data), fixture.AS_OF)
    assert not replaced.isEmpty()
    again = edges.statements(raw, fixture.AS_OF)
    assert dedupe.person_pairs(raw.entities, again).join(replaced.select(F.col("entity_id").alias("a")), "a", "left_semi").isEmpty()


def test_survivor_attributes_win(spark):
    own = spark.createDataFrame([("a", {"x": "1"}), ("b", {"x": "2", "y": "3"}), ("c", {"y": "4"})], "entity_id string, attributes map<string,string>")
    lost = spark.createDataFrame([("b", "a"), ("c", "a")], "entity_id string, survivor string")
    assert dedupe.fold_attributes(own, lost).first()["attributes"] == {"x": "1", "y": "3"}


def pooled(points):
    """Pools of adjacent violators over (score, mean, weight), one by one."""
    pools = []
    for score, mean, n in sorted(points):
        pools.append([mean * n, n, [score]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            total, weight, scores = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + weight, pools[-1][2] + scores]
    return {score: round(total / n, 6) for total, n, scores in pools for score in scores}


def test_isotonic_is_pooling_of_violators(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(400)]
    by = {}
    for score, label in rows:
        by.setdefault(score, []).append(label)
    found = {r.score: r.fitted for r in matcher.isotonic(spark.createDataFrame(rows, "score double, label int")).collect()}
    assert found == pooled((s, sum(x) / len(x), len(x)) for s, x in by.items())
    assert list(dict(sorted(found.items())).values()) == sorted(found.values())


def test_places_and_ranks_over_many_partitions(spark):
    rows = [(i, i * 37 % 100 // 7, "ab"[i % 3 == 0]) for i in range(300)] + [(301, None, "a")]
    df = spark.createDataFrame(rows, "id long, v long, cohort string").repartition(5)
    value = lambda r: -1 if r[1] is None else r[1]
    for r in ranks.ranked(df, "v", "cohort").collect():
        own = [x for x in rows if x[2] == r.cohort]
        assert r.cohort_size == len(own) and r["rank"] == 1 + sum(value(x) > value((0, r.v)) for x in own)
    order = sorted(rows, key=lambda x: (value(x), x[0]))
    assert {(r.id, r.place, r.n_places) for r in ranks.placed(df, F.asc_nulls_first("v"), F.asc("id")).collect()} == {(x[0], i, 301) for i, x in enumerate(order, 1)}
    before = {r.id: r.total for r in ranks.running(df, [F.asc_nulls_first("v"), F.asc("id")], {"total": F.coalesce("v", F.lit(0))}).collect()}
    assert before == {x[0]: sum(max(0, value(y)) for y in order[:i]) for i, x in enumerate(order)}
    assert ranks.ranked(df.limit(0), "v").count() == 0


def made_findings(spark, n):
    rows = [(f"f{i:03}", ["A", "B", "C", "D", "E"][i % 5], [f"m{i % 40}", f"x{i}"], round(1 - i / 1000, 4)) for i in range(n)] + [("quiet", "QUIET_PORTFOLIO", ["q"], 9.0)]
    return spark.createDataFrame(rows, "finding_id string, shape_code string, member_ids array<string>, surprise double"), rows[:-1]


def test_hands_are_drawn_as_told(spark):
    found, rows = made_findings(spark, 200)
    first, shapes = [], set()
    for seed in range(6):
        cards = reads.hand(found, seed).orderBy("card").collect()
        assert [c.card for c in cards] == [1, 2, 3, 4] and "quiet" not in {c.finding_id for c in cards}
        assert len({c.shape_code for c in cards}) == 4 and len({m for c in cards for m in c.member_ids}) == 8
        first.append(cards[0].finding_id)
        shapes |= {c.finding_id for c in cards[1:]}
    assert set(first) <= {r[0] for r in rows[:10]} and len(set(first)) > 2 and len(shapes) > 9
    assert [c.finding_id for c in reads.hand(found, 1).orderBy("card").collect()] == [c.finding_id for c in reads.hand(found, 1).orderBy("card").collect()]
    seen = spark.createDataFrame([(r[0],) for r in rows[:150]], "finding_id string")
    assert {c.finding_id for c in reads.hand(found, 1, seen=seen).collect()} <= {r[0] for r in rows[150:]}
    alike, _ = made_findings(spark, 200)
    alike = alike.where("shape_code = 'A'")
    assert reads.hand(alike, 2).count() == 4  # rather a repeat than a short hand
    assert reads.hand(found.where("shape_code = 'A'").limit(2), 1).count() == 2


def test_hand_equals_brute_force(spark):
    found, rows = made_findings(spark, 60)

    hashed = {(r.finding_id, c): r[f"h{c}"] for r in found.select("finding_id", *(F.pmod(F.xxhash64("finding_id", F.lit("7"), F.lit(c)), F.lit(1 << 30)).alias(f"h{c}") for c in range(1, 5))).collect() for c in range(1, 5)}
    pool = sorted(rows, key=lambda r: (-r[3], r[0]))
    held = []
    for card in range(1, 5):
        draws = []
        for rank, r in enumerate(pool):
            if r in held or (card == 1 and rank >= 10):
                continue
            u = (hashed[r[0], card] + 1) / ((1 << 30) + 1)
            draws.append((-math.log(u) * (math.exp(rank / 25) if card > 1 else 1), r[0], r))
        draws = sorted(draws, key=lambda x: x[:2])[: reads.TRIES]
        free = [d for d in draws if not any(d[2][1] == h[1] or set(d[2][2]) & set(h[2]) for h in held)]
        held.append((free or draws)[0][2])
    assert [c.finding_id for c in reads.hand(found, 7).orderBy("card").collect()] == [h[0] for h in held]


def test_pivots_go_by_name(spark):
    entities = spark.createDataFrame([("1", "Ann"), ("2", "Acme"), ("3", "Blue")], "entity_id string, name string")
    rows = [("a", "FAMILY_DESK", ["1", "2"], {"company": "Acme"}), ("b", "BIG_MONEY", ["1", "3"], {"donor": "Nobody"}), ("c", "CROSSING", ["3", "2"], {"entity": "Acme"}), ("d", "OTHER", ["3", "1"], {"donor": "Ann"})]
    found = spark.createDataFrame(rows, "finding_id string, shape_code string, member_ids array<string>, slots map<string,string>")
    assert dict(reads.pivot_entity(found, entities).collect()) == {"a": "2", "b": "1", "c": "2", "d": "3"}


def test_sentences_leave_out_what_is_missing(spark):
    rows = [
        ("LOOP_CLOSED", {"company": "Acme", "party": "Labour", "donation_gbp": "1234.5", "contract_count": "1"}, "Acme gave £1,235 to Labour. It also holds 1 public contract."),
        ("LOOP_CLOSED", {"company": "Acme", "party": "Rail Party"}, "Acme is a donor to the Rail Party."), ("BIG_MONEY", {"donor": "Ann", "recipient": "SNP"}, "Ann made a donation to the SNP."),
        ("OVERSEAS_MONEY", {"amount_gbp": "5", "recipient": "Green"}, "£5 to the Green Party from a donor with an overseas registered residence."),
        ("SECTOR_OVERLAP", {"mp": "Ann"}, "Ann sits where their declared interests overlap."), ("UNKNOWN", {}, "A sourced structural pattern in the public registers."),
    ]
    found = spark.createDataFrame([(str(i), s, x) for i, (s, x, _) in enumerate(rows)], "finding_id string, shape_code string, slots map<string,string>")
    texts = {r.finding_id: r for r in sentences.finding_texts(found).collect()}
    assert [texts[str(i)].headline for i in range(len(rows))] == [r[2] for r in rows]
    long = found.limit(1).withColumn("slots", F.create_map(F.lit("company"), F.repeat(F.lit("x"), 400), F.lit("n_registers"), F.lit("1")))
    share = sentences.finding_texts(long).first().share
    assert len(share) <= sentences.SHARED_CHARS + 1 and "…" in share and share.endswith("Sourced from 1 public register. ")
    kinds = [("BASIC", {"n_ties": "1"}, "1 sourced connection."), ("NEAREST_NOTABLE", {"hops": "2", "notable_name": "Ann"}, "2 steps from Ann in the register graph."), ("BRIDGE", {}, "Appears across multiple public registers.")]
    told = spark.createDataFrame([(str(i), k, None, x) for i, (k, x, _) in enumerate(kinds)], "insight_id string, kind string, rank long, slots map<string,string>")
    assert [r.sentence for r in sentences.insight_texts(told).orderBy("insight_id").collect()] == [k[2] for k in kinds]


def test_whole_build_from_landed_registers(spark, data, tmp_path):
    landed = landing.everything(spark, data)
    built = build.from_landed(checkpointed(landed.mentions), checkpointed(landed.assertions), fixture.AS_OF)
    path = f"file://{tmp_path}/builds"
    ids = [build.write(built, path), build.write(built, path)]
    assert sinks.current_build(spark, path) == ids[1]
    tables = {name: sinks.read_build(spark, path, name) for name in built.tables()}
    assert all(not df.isEmpty() for name, df in tables.items() if name not in ("overseas_leads", "suggested_pairs"))
    known = tables["entities"].select("entity_id")
    ends = findings.both_ends(tables["statements"]).distinct()
    assert ends.join(known, "entity_id", "left_anti").isEmpty()
    assert known.join(tables["insights"], "entity_id", "left_anti").isEmpty()
    assert tables["replaced"].join(known, "entity_id", "left_semi").isEmpty()
    assert tables["entities"].where("attributes['nationality'] = 'British' and jurisdiction is not null").count() > 0

    def broken(rows):
        raise ValueError("stop")

    bad = built.tables()
    bad["insights"] = bad["insights"].mapInPandas(broken, bad["insights"].schema)
    with pytest.raises(Exception, match="stop"):
        sinks.publish(bad, path, "bad")
    assert sinks.current_build(spark, path) == ids[1] and not (tmp_path / "builds" / "bad").exists()
    assert sinks.read_build(spark, path, "entities").count() == tables["entities"].count()
    build.write(built, path)
    assert len([p for p in (tmp_path / "builds").iterdir() if p.is_dir()]) == 2


def test_conflicts_leave_out_inner_bodies_and_party_work(spark):
    people = [(i, "person", f"Ann {n}", "mp", None) for i, n in (("1", "Able"), ("2", "Baker"), ("3", "Cole"), ("4", "Dean"))]
    bodies = [("b1", "organisation", "Energy Security Committee", None, None), ("b2", "organisation", "Finance Committee", None, None)]
    orgs = [("o1", "company", "Solar Roofs Ltd", None, None), ("o2", "company", "Able Votes", None, None), ("o3", "company", "Plain Ltd", None, None)]
    entities = spark.createDataFrame(people + bodies + orgs, "entity_id string, entity_type string, name string, category string, jurisdiction string")
    ties = [("1", "MEMBER_OF", "b1"), ("1", "OWNS", "o1"), ("2", "MEMBER_OF", "b2"), ("2", "OWNS", "o1"), ("3", "MEMBER_OF", "b1"), ("3", "DIRECTOR_OF", "o2"), ("4", "CHAIR_OF", "b1"), ("4", "DIRECTOR_OF", "o3")]
    statements = spark.createDataFrame([(f"s{k}", a, t, b, 1.0) for k, (a, t, b) in enumerate(ties)], "statement_id string, subject_id string, statement_type string, object_id string, confidence double")
    mentions = spark.createDataFrame([("o2", " Campaign support "), ("o2", "campaign support"), ("o3", None), ("o3", "")], "entity_id string, description string")
    told = attention.descriptions(mentions)
    assert {tuple(r) for r in told.collect()} == {("o2", "campaign support campaign support")}
    found = {r.entity_id: (r.conflict_flag, r.conflict_strength, r.conflict_overlap) for r in attention.conflicts(entities, statements, told, attention.LEXICON).collect()}
    assert found == {"1": (True, "strong", "energy"), "2": (False, None, None), "3": (True, "low", None), "4": (True, "medium", None)}


def small(spark, ties):
    ids = sorted({x for a, b, *_ in ties for x in (a, b)})
    entities = spark.createDataFrame([(i, "person", i, None, None) for i in ids], "entity_id string, entity_type string, name string, category string, jurisdiction string")
    rows = [(f"s{k}", a, "KNOWS", b, c, s, ["r"]) for k, (a, b, c, s) in enumerate(ties)]
    statements = spark.createDataFrame(rows, "statement_id string, subject_id string, statement_type string, object_id string, confidence double, strength double, sources array<string>")
    return Graph(entities, statements, None, "2020-01-01")


def test_shortest_path_minds_the_threshold(spark):
    g = small(spark, [("a", "b", 0.9, 0.5), ("b", "d", 0.9, 0.5), ("a", "d", 0.3, 0.5), ("d", "e", 0.9, 0.1)])
    path = lambda least: [r.entity_id for r in reads.shortest_path(g, "a", "d", least).orderBy("hop").collect()]
    assert path(0) == ["a", "d"]
    assert path(50) == ["a", "b", "d"]
    assert reads.shortest_path(g, "a", "z").isEmpty()


def test_surroundings_keep_the_strongest(spark):
    g = small(spark, [("a", "b", 0.9, 0.1), ("a", "c", 0.9, 0.9), ("c", "d", 0.9, 0.9)])
    assert {tuple(r) for r in reads.surroundings(g, "a", cap=2).collect()} == {("a", 0), ("c", 1)}
    assert {tuple(r) for r in reads.surroundings(g, "a").collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_matcher_scores_every_person(spark, data, g):
    people = queries.QUERIES["fs_score_pairs_everyone"](spark, data)
    named = queries.everyone(spark, data)
    assert named.count() == g.entities.where("entity_type = 'person'").count() > queries.people(spark, data).count()
    sizes = [r["count"] for r in named.where("surname != ''").groupBy("surname").count().collect()]
    assert people.count() == sum(n * (n - 1) // 2 for n in sizes)
    persons = {r.entity_id for r in named.collect()}
    ties = {e for a, b in g.statements.select("subject_id", "object_id").collect() for e in ((a, b), (b, a))}
    assert {(r.entity_id, n) for r in named.collect() for n in r.neighbours} == {(a, b) for a, b in ties if a in persons}


def test_priorities_round_as_products(spark):
    """Shares of cohorts of 2000 lie on halves of the last digit, where the decimal text rounds another way."""
    rows = spark.range(2000).select((0.9 * (1 - F.col("id") / 2000)).alias("x"))
    half_up = lambda y: math.floor(y) + (y - math.floor(y) >= 0.5)
    found = rows.select("x", insights._rounded(F.col("x"), 4)).collect()
    assert [y for _, y in found] == [half_up(x * 1e4) / 1e4 for x, _ in found]


def test_evidence_of_a_doubtful_crossing(spark):
    """A tie below the gate takes the finding away, not the statements that the entity's crossing rests on."""
    entity = spark.createDataFrame([("C1", "company", "One"), ("P1", "person", "A B"), ("P2", "person", "C D"), ("P3", "person", "E F")], "entity_id string, entity_type string, name string")
    rows = [(f"s{i}", f"P{i}", "OWNS", "C1", 0.4 if i == 1 else 0.9, i / 10, [source]) for i, source in enumerate(("a", "b", "c"), start=1)]
    told = spark.createDataFrame(rows, "statement_id string, subject_id string, statement_type string, object_id string, confidence double, strength double, sources array<string>")
    g = Graph(entity, told, entity.limit(0), "2001-08-01")
    assert findings.findings(g, "CROSSING").isEmpty()
    assert [r.statement_id for r in reads.evidence(g, queries._crossing_of(g, "C1")).collect()] == ["s3", "s2", "s1"]


def test_last_insights_heed_all_others(spark, data, g):
    found = queries.QUERIES["insights_all"](spark, data).select("entity_id", "kind").collect()
    last = {r.entity_id for r in found if r.kind in ("NEAREST_NOTABLE", "BASIC")}
    ranked = {r.entity_id for r in found} - last
    assert not last & {r.entity_id for r in found if r.kind not in ("NEAREST_NOTABLE", "BASIC")}
    assert ranked | last == {r.entity_id for r in g.entities.collect()}
    assert {r.kind for r in found} >= {"RANK_MONEY_GIVEN", "RANK_MONEY_RECEIVED", "RANK_PORTFOLIO", "BRIDGE"}
    assert {r.entity_id for r in queries.QUERIES["insight_basic"](spark, data).collect()} & ranked


def test_scores_on_a_half_are_rounded_as_in_sql(spark):
    """A donor with two ties and four registers: 0.95 * (0.4 + 0.6 / 2) * 2.5 * 0.5 is 0.8312499999999999 in doubles."""
    entity = spark.createDataFrame([("P1", "person", "A B"), ("C1", "company", "One"), ("C2", "company", "Two")], "entity_id string, entity_type string, name string")
    rows = [(f"s{i}", "P1", "OWNS", f"C{i}", ["a", "b", "c", "d"]) for i in (1, 2)]
    told = spark.createDataFrame(rows, "statement_id string, subject_id string, statement_type string, object_id string, sources array<string>")
    shape = "shape_code string, member_ids array<string>, statement_ids array<string>, slots map<string,string>, total_gbp double, min_confidence double"
    candidate = spark.createDataFrame([("OVERSEAS_MONEY", ["P1"], ["s1"], {}, 0.0, 0.9)], shape)
    (found,) = findings.score(Graph(entity, told, entity.limit(0), "2001-08-01"), candidate).select("surprise").collect()
    x = 0.95 * (0.4 + 0.6 * 0.5) * 2.5 * 0.5
    assert x == 0.8312499999999999
    assert found.surprise == duckdb.connect().execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] == 0.8313


def test_pairs_are_made_once_without_a_shuffle_of_pairs(spark):
    """Of persons of one name with three neighbours and a birth in common each pair is there once, and no step drops repeats after the join."""
    entity = spark.createDataFrame([(f"P{i:02}", "person", "A B") for i in range(30)] + [(f"C{j}", "company", f"X {j}") for j in range(3)], "entity_id string, entity_type string, name string")
    told = spark.createDataFrame([(f"P{i:02}", f"C{j}") for i in range(20) for j in range(3)], "subject_id string, object_id string")
    births = spark.createDataFrame([(f"P{i:02}", "1910" if i % 2 else "1910-01") for i in range(10, 30)], "entity_id string, dob string")
    for born, n in ((None, 20), (births, 30)):
        pairs = dedupe.person_pairs(entity, told, born)
        found = [tuple(r) for r in pairs.collect()]
        expected = {(a, b) for a in range(n) for b in range(a + 1, n) if b < 20 or a >= 10}
        assert len(found) == len(set(found)) and set(found) == {(f"P{a:02}", f"P{b:02}") for a, b in expected}
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]


def test_pairs_and_bands_equal_scores_of_all_pairs(spark, data):
    """Also where most neighbours are frequent and blocks have many shares; pairs are not shuffled once they are made."""
    people = checkpointed(queries.everyone(spark, data))
    own = people.where("surname != ''")
    a, b = (own.select("surname", F.col("entity_id").alias(x)) for x in "ab")
    plain = matcher.scored(checkpointed(a.join(b, "surname").where("a < b").select("a", "b")), people)
    columns = ["a", "b", "surname", "score", "across", "n_shared", "band"]
    expected = sorted(tuple(r) for r in plain.select(*columns).collect())
    bands = sorted(tuple(r) for r in plain.groupBy("band", "across").agg(F.count("*")).collect())
    for often in (0, 3, 10_000):
        found = matcher.pairs(people, often, share=5)
        assert sorted(tuple(r) for r in found.select(*columns).collect()) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]
        assert sorted(tuple(r) for r in matcher.band_counts(people, often).collect()) == bands


def test_gold_report_equals_the_report_of_its_pairs(spark, data):
    """Counted by classes, also where most neighbours are frequent."""
    from tieweave.plans import extended

    people = extended.person_mentions(spark, data)
    expected = sorted(tuple(r) for r in matcher.report(matcher.scored(checkpointed(matcher.gold(people)), people)).collect())
    for often in (0, 10_000):
        assert sorted(tuple(r) for r in matcher.gold_report(people, often=often).collect()) == expected


def test_donors_of_overseas_leads_are_those_of_the_pairs_and_make_none(spark):
    """A donor who is the only person abroad of a name has no lead; 300 donors of one name are 300 rows, not 90,000."""
    people = [("P1", "A B", "N5"), ("P2", "C D", "N5"), ("P3", "C D", "GB"), ("P4", "E F", "GB"), ("P5", "G H", "N5"), ("P6", "G H", "N5")] + [(f"Q{i}", "X Y", "N5") for i in range(300)]
    entities = spark.createDataFrame([(i, "person", n, None, j) for i, n, j in people] + [("R1", "party", "Z", None, None)], "entity_id string, entity_type string, name string, category string, jurisdiction string")
    ties = spark.createDataFrame([(f"s{i}", "DONATED_TO", i, "R1", 300_000.0) for i, _, _ in people], "statement_id string, statement_type string, subject_id string, object_id string, amount_gbp double")
    small, keys = Graph(entities, ties, None, fixture.AS_OF), dedupe.person_keys(entities)
    found = [r.donor_id for r in findings.overseas_donors(small, keys).collect()]
    assert sorted(found) == sorted({r.donor_id for r in findings.overseas_leads(small, keys).select("donor_id").collect()})
    assert len(found) == 303 and {"P3", "P5", "P6"} <= set(found)


def test_places_of_overseas_leads_equal_a_window_and_shuffle_no_pairs(spark, data):
    """Also where names have more persons abroad than one list takes; a donor abroad is no lead of its own."""
    g = queries.graph(spark, data)
    keys = dedupe.person_keys(g.entities)
    plain = reads.by_entity(findings.overseas_leads(g, keys, 1), "donor_id", F.asc("lead_id")).select("donor_id", "lead_id", "place")
    expected = sorted(tuple(r) for r in plain.collect())
    assert expected
    for listed in (0, 3, 100_000):
        assert sorted(tuple(r) for r in findings.overseas_places(g, keys, 1, listed).select("donor_id", "lead_id", "place").collect()) == expected
    used = queries.extended.queries(queries.graph, queries.mentions)["load_extras"](spark, data)
    assert used.count() == reads.extras(None, None, findings.overseas_leads(g, keys)).count() + used.where("extra != 'overseas'").count()
    places = findings.overseas_places(g, keys, 1).where("place > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in places[: places.index("Window")]


@pytest.mark.parametrize("made", ["leads", "gold"])
def test_pairs_of_one_name_are_made_in_many_tasks(spark, made):
    n = 60
    if made == "leads":
        people = [(f"P{i:02}", "person", "Ann Lee", None, "FR" if i % 2 else "GB") for i in range(n)] + [("R", "party", "Party", "party", None)]
        entities = spark.createDataFrame(people, "entity_id string, entity_type string, name string, category string, jurisdiction string")
        gifts = [(f"S{i}", f"P{i:02}", "R", "DONATED_TO", 300_000.0, 0.9) for i in range(n)]
        ties = spark.createDataFrame(gifts, "statement_id string, subject_id string, object_id string, statement_type string, amount_gbp double, confidence double")
        found = findings.overseas_leads(Graph(entities, ties, None, fixture.AS_OF), dedupe.person_keys(entities))
        expected = {(f"P{i:02}", n // 2 - i % 2) for i in range(n)}
        assert {tuple(r) for r in found.groupBy("donor_id").count().collect()} == expected
    else:
        rows = [(f"m{i:02}", f"P{i // 2}", "Ann Lee", "lee", ["ann"], [f"C{i % 5}"], ["a"], str(1950 + i % 3)) for i in range(n)]
        people = spark.createDataFrame(rows, "entity_id string, group string, name string, surname string, forenames array<string>, neighbours array<string>, sources array<string>, birth_year string")
        found = matcher.gold(people, 2)
        kind = lambda i, j: "one_entity" if i // 2 == j // 2 else "neighbour" if i % 5 == j % 5 else "birth_year" if i % 3 == j % 3 else ""
        expected = {(f"m{i:02}", f"m{j:02}", f"positive_{k}" if (k := kind(i, j)) else "hard_negative") for i in range(n) for j in range(i + 1, n)}
        assert sorted(tuple(r) for r in found.select("a", "b", "kind").collect()) == sorted(expected)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_shared_neighbours_are_compared_once_for_each_pair(spark):
    """A score uses them several times; as an expression each use would be another comparison."""
    columns = "entity_id string, name string, surname string, forenames array<string>, neighbours array<string>, sources array<string>"
    people = spark.createDataFrame([(f"P{i}", "Jo Baker", "baker", ["jo"], ["N1", f"M{i % 3}"], ["s"]) for i in range(6)], columns)
    for found in (matcher.pairs(people, often=1), matcher.band_counts(people, often=6)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        compared = [line for line in plan.splitlines() if "array_intersect(names_a" in line]
        assert compared and all(line.count("array_intersect(names_a") == 1 for line in compared)
    assert matcher.pairs(people, often=1).count() == 15
