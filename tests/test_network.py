"""Paths, control and centrality against plain versions on small graphs."""

import math
import random
from collections import defaultdict, deque

import pytest

from tieweave import schemas
from tieweave.operators import centrality, control, paths, reads
from tieweave.operators.findings import Graph
from tieweave.plans import queries

KINDS = ["DIRECTOR_OF", "OWNS", "MEMBER_OF", "DONATED_TO"]


def small_graph(spark, seed, n=11, ties=26, hub_ties=0):
    rng = random.Random(seed)
    kinds = [("h0", "party")] + [(f"e{i:02}", "person") for i in range(n)]
    names = [k for k, _ in kinds]
    rows = []
    for i in range(ties):
        a, b = rng.sample(names, 2)
        rows.append((f"s{i:03}", a, rng.choice(KINDS), b, round(rng.uniform(0.3, 1), 4), 0.5, rng.sample(["x", "y", "z"], rng.randint(1, 2))))
    rows += [(f"t{i:03}", "e00", "OWNS", f"e{1 + i % (n - 1):02}", 0.5, 0.5, ["x"]) for i in range(hub_ties)]
    rows.append(("loop", "e00", "OWNS", "e00", 1.0, 0.5, ["x"]))
    statements = spark.createDataFrame(rows, "statement_id string, subject_id string, statement_type string, object_id string, confidence double, strength double, sources array<string>")
    entities = spark.createDataFrame([(e, t, e, None, "GB") for e, t in kinds], schemas.ENTITIES)
    return Graph(entities, statements, entities.limit(0), "2020-01-01"), rows, names


def plain_paths(rows, start, goal, hops, keep, damping=0.85):
    best = {}
    for sid, a, kind, b, confidence, _, sources in rows:
        tie = (-confidence * schemas.STATEMENT_TYPES[kind][1], sid, confidence, sources)
        for x, y in ((a, b), (b, a)):
            if a != b and tie < best.get((x, y), (1,)):
                best[x, y] = tie
    near = defaultdict(list)
    for (x, y), tie in best.items():
        near[x].append((y, tie))
    found = []

    def walk(path, score, ties):
        if path[-1] == goal:
            by = defaultdict(lambda: 1.0)
            for _, _, c, sources in ties:
                by[tuple(sources)] = min(by[tuple(sources)], c)
            found.append((-round(score, 9), path, [t[1] for t in ties], math.prod(by.values()), sorted({s for t in ties for s in t[3]})))
        elif len(path) <= hops and (len(path) == 1 or not path[-1].startswith("h")):
            for y, tie in near[path[-1]]:
                if y not in path:
                    walk(path + [y], score * -tie[0] * (damping if ties else 1), ties + [tie])

    walk([start], 1.0, [])
    return sorted(found)[:keep]


@pytest.mark.parametrize(("seed", "hops", "share"), [(1, 4, 10_000), (2, 5, 2), (3, 2, 3)])
def test_best_paths_equal_all_paths(spark, seed, hops, share):
    g, rows, names = small_graph(spark, seed, hub_ties=40)
    pairs = [(a, b) for a in names[:4] for b in names[3:9]]
    df = spark.createDataFrame([*pairs, pairs[0], (None, "e01"), ("e01", None), ("e01", "nobody")], "start_id string, goal_id string")
    found = paths.best_paths(g, df, hops=hops, keep=3, share=share)
    got = defaultdict(list)
    for r in found.orderBy("place").collect():
        got[r.start_id, r.goal_id].append((pytest.approx(-r.score, abs=1e-8), r.path, r.statement_ids, pytest.approx(r.confidence), r.sources))
    want = {p: w for p in pairs if p[0] != p[1] and (w := plain_paths(rows, *p, hops, 3))}
    assert dict(got) == want
    together = {(r.start_id, r.goal_id): r for r in paths.connections(found).collect()}
    assert set(together) == set(want)
    for pair, own in want.items():
        seen, doubt, n = set(), 1.0, 0
        for p in own:
            if not seen & set(p[4]):
                seen, doubt, n = seen | set(p[4]), doubt * (1 - p[3]), n + 1
        r = together[pair]
        assert (r.n_paths, r.n_independent, r.confidence) == (len(own), n, pytest.approx(1 - doubt))
        assert r.strength == pytest.approx(1 - math.prod(1 + p[0] for p in own), abs=1e-6) and r.best == pytest.approx(-own[0][0], abs=1e-8)


def test_worked_example_of_corroboration(spark):
    """Two steps of 0.7 and 0.6 are 0.42; a second route of 0.5 from another source makes it 0.71."""
    rows = [("a", "p", "OWNS", "shell", 0.7, 0.5, ["s1"]), ("b", "shell", "OWNS", "asset", 0.6, 0.5, ["s2"]), ("c", "p", "CO_MENTION", "asset", 0.5, 0.5, ["s3"])]
    statements = spark.createDataFrame(rows, "statement_id string, subject_id string, statement_type string, object_id string, confidence double, strength double, sources array<string>")
    entities = spark.createDataFrame([(e, "company", e, None, "GB") for e in ("p", "shell", "asset")], schemas.ENTITIES)
    g = Graph(entities, statements, entities.limit(0), "2020-01-01")
    found = paths.best_paths(g, spark.createDataFrame([("p", "asset")], "start_id string, goal_id string"))
    assert [round(r.confidence, 2) for r in found.orderBy("place").collect()] == [0.42, 0.5]
    assert round(paths.connections(found).first().confidence, 2) == 0.71
    empty = Graph(entities.limit(0), statements.limit(0), entities.limit(0), "2020-01-01")
    assert paths.best_paths(empty, spark.createDataFrame([("p", "asset")], "start_id string, goal_id string")).collect() == []
    assert paths.best_paths(g, spark.createDataFrame([], "start_id string, goal_id string")).collect() == []


def test_ties_of_a_hub_are_split(spark):
    edges = spark.createDataFrame([("hub", f"b{i}") for i in range(1000)] + [("c", "b1")], "a string, b string")
    ties = paths.Ties(edges, share=50)
    assert ties.large.collect() == [("hub", 20)]
    sizes = [r["count"] for r in ties.edges.where("a = 'hub'").groupBy("salt").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 100
    met = ties.meet(spark.createDataFrame([("hub", 1), ("c", 2)], "at string, x int"), "at")
    assert met.count() == 1001 and met.columns == ["at", "x", "b"]


def plain_control(held, least):
    best = defaultdict(float)
    for a, b, share in held:
        if a != b and min(share, 1) >= least:
            best[a, b] = max(best[a, b], min(share, 1.0))
    base = dict(best)
    changed = True
    while changed:
        changed = False
        for (a, b), s in list(best.items()):
            for (c, d), t in base.items():
                if c == b and d != a and s * t >= least and s * t > best[a, d]:
                    best[a, d], changed = s * t, True
    return best


@pytest.mark.parametrize("seed", range(3))
def test_control_reaches_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    held = [(f"c{rng.randrange(12)}", f"c{rng.randrange(12)}", rng.choice([0.2, 0.5, 0.75, 0.9, 1.0])) for _ in range(30)]
    df = spark.createDataFrame([*held, held[0], (None, "c1", 1.0), ("c1", None, 1.0), ("c1", "c2", None), ("c3", "c4", -1.0)], "owner_id string, owned_id string, share double")
    found = control.control(df, least=0.25).collect()
    assert {(r.controller_id, r.company_id): pytest.approx(r.share) for r in found} == dict(plain_control(held, 0.25))
    assert len(found) == len({(r.controller_id, r.company_id) for r in found})


def test_control_of_cycles_and_long_chains(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}", 1.0) for i in range(5)] + [(f"l{i:02}", f"l{i + 1:02}", 1.0) for i in range(12)] + [("r0", "l00", 0.5), ("top", "r2", 2.0)]
    found = {(r.controller_id, r.company_id): (r.share, r.steps) for r in control.control(spark.createDataFrame(ring, "owner_id string, owned_id string, share double")).collect()}
    assert all(found[f"r{i}", f"r{j}"] == (1.0, (j - i) % 5) for i in range(5) for j in range(5) if i != j) and ("r0", "r0") not in found
    assert found["l00", "l12"] == (1.0, 12) and found["top", "l12"] == (0.5, 17)
    empty = control.control(spark.createDataFrame([], "owner_id string, owned_id string, share double"))
    assert empty.collect() == [] and control.common_control(empty).collect() == []
    tops = {r.company_id: (r.controller_id, r.place) for r in control.ultimate(control.control(spark.createDataFrame(ring, "owner_id string, owned_id string, share double"))).collect()}
    assert tops["l12"] == ("top", 1) and tops["r2"] == ("top", 1)


def test_common_control_of_a_hot_controller(spark):
    held = [("big", f"c{i:04}", 0.5 + (i == 7) / 4) for i in range(1000)] + [(f"o{i}", f"c{j:04}", 0.5) for i in range(600) for j in (i, i + 1, 1000 + i)] + [("one", "c0001", 1.0)]
    members = control.common_control(control.control(spark.createDataFrame(held, "owner_id string, owned_id string, share double")))
    rows = members.collect()
    assert len(rows) == len(held) - 1  # as many as memberships, not pairs
    big = [r for r in rows if r.controller_id == "big"]
    assert len(big) == 1000 and {(r.first_id, r.first_share, r.n_members) for r in big} == {("c0007", 0.75, 1000)}
    pairs = {(r.first_id, r.company_id): (r.n_controllers, round(r.confidence, 4)) for r in control.related(members).collect()}
    assert pairs["c0007", "c0500"] == (1, 0.375) and pairs["c0007", "c0008"] == (2, round(1 - (1 - 0.375) * (1 - 0.25), 4))
    near = control.related_to(members, "c0003").collect()
    assert len(near) == 999 + 2 and near[0].company_id == "c0002" and near[0].n_controllers == 2


def plain_ranks(names, weights, damping=0.85, rounds=200):
    total = defaultdict(float)
    for (a, _), w in weights.items():
        total[a] += w
    ranks = dict.fromkeys(names, 1 / len(names))
    for _ in range(rounds):
        loose = sum(ranks[a] for a in names if not total[a])
        new = dict.fromkeys(names, (1 - damping) / len(names) + damping * loose / len(names))
        for (a, b), w in weights.items():
            new[b] += damping * ranks[a] * w / total[a]
        ranks = new
    return ranks


def test_pagerank_keeps_its_mass(spark):
    g, rows, names = small_graph(spark, 5, n=14, ties=18)
    weights = defaultdict(float)
    for _, a, _, b, confidence, _, _ in rows:
        if a != b:
            weights[a, b] += confidence
            weights[b, a] += confidence
    assert len({a for a, _ in weights}) < len(names)  # some dangle
    found = {r.entity_id: r.rank for r in centrality.pagerank(g.entities, centrality.weighted(g), tolerance=1e-3, share=2).collect()}
    assert sum(found.values()) == pytest.approx(1) and found == pytest.approx(plain_ranks(names, weights), abs=5e-3)
    found = {r.entity_id: r.rank for r in centrality.pagerank(g.entities, centrality.weighted(g), tolerance=0, rounds=5).collect()}
    assert found == pytest.approx(plain_ranks(names, weights, rounds=5), abs=1e-12)
    assert centrality.pagerank(g.entities.limit(0), centrality.weighted(g)).collect() == []
    alone = centrality.pagerank(g.entities, centrality.weighted(g).limit(0)).collect()
    assert {round(r.rank, 9) for r in alone} == {round(1 / len(names), 9)}


def plain_betweenness(names, near, sources):
    score = defaultdict(float)
    for s in sources:
        order, paths_to, distance, before = [], defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    queue.append(w)
                if distance[w] == distance[v] + 1:
                    paths_to[w] += paths_to[v]
                    before[w].append(v)
        handed = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                handed[v] += paths_to[v] / paths_to[w] * (1 + handed[w])
            if w != s:
                score[w] += handed[w]
    return {k: v for k, v in score.items() if v > 0}


def test_betweenness_is_exact_and_its_sample_near(spark):
    rng = random.Random(4)
    names = [f"n{i:03}" for i in range(90)]
    # Two crowds and a broker: a sample has to find the broker.
    ties = {tuple(rng.sample(names[:45], 2)) for _ in range(150)} | {tuple(rng.sample(names[46:], 2)) for _ in range(150)} | {("n045", "n003"), ("n045", "n050")}
    near = defaultdict(set)
    for a, b in ties:
        near[a].add(b)
        near[b].add(a)
    edges = spark.createDataFrame([(a, b) for a in near for b in near[a]], "a string, b string")
    entities = spark.createDataFrame([(n,) for n in names], "entity_id string")
    exact = plain_betweenness(names, near, names)
    whole = {r.entity_id: r.betweenness for r in centrality.betweenness(edges, centrality.pivots(entities, None), share=4).collect()}
    assert whole == pytest.approx(exact)
    chosen = centrality.pivots(entities, 30)
    sample = {r.entity_id: r.betweenness for r in centrality.betweenness(edges, chosen, scale=90 / 30).collect()}
    assert sample == pytest.approx({k: 3 * v for k, v in plain_betweenness(names, near, [r.source for r in chosen.collect()]).items()})
    error = sum(abs(sample.get(k, 0) - v) for k, v in exact.items()) / sum(exact.values())
    assert error < 0.2 and max(sample, key=sample.get) in sorted(exact, key=exact.get)[-3:]
    assert centrality.betweenness(edges.limit(0), chosen).collect() == []


def test_shortest_path_has_no_bound(spark):
    rows = [(f"s{i}", f"n{i:02}", "OWNS", f"n{i + 1:02}", 1.0, 0.5, ["x"]) for i in range(40)]
    statements = spark.createDataFrame(rows, "statement_id string, subject_id string, statement_type string, object_id string, confidence double, strength double, sources array<string>")
    entities = spark.createDataFrame([(f"n{i:02}", "company", "x", None, "GB") for i in range(42)], schemas.ENTITIES)
    g = Graph(entities, statements, entities.limit(0), "2020-01-01")
    assert [r.entity_id for r in reads.shortest_path(g, "n00", "n40").orderBy("hop").collect()] == [f"n{i:02}" for i in range(41)]
    assert reads.shortest_path(g, "n00", "n41").collect() == []


def test_frontiers_carry_no_statements_and_ties_are_not_shuffled_again(spark, data, monkeypatch):
    g = queries.graph(spark, data)
    kept = []
    for name in ("written", "checkpointed"):
        plain = getattr(paths, name)
        monkeypatch.setattr(paths, name, lambda df, plain=plain: kept.append(set(df.columns)) or plain(df))
    pairs = spark.createDataFrame([("P0", "P1"), ("P50", "R0")], "start_id string, goal_id string")
    assert paths.best_paths(g, pairs).count() > 0
    assert not any({"statement_ids", "grounds", "sources"} & columns for columns in kept)
    ties = paths.Ties(paths.steps(g).select("a", "b"), share=5, buckets=True)
    assert ties.large.count() > 0
    front = spark.createDataFrame([("P0", 1)], "at string, n int")
    plan = ties.meet(front, "at")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
