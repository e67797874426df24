"""Exact, near and line dedup against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from tieweave.llm import exact, line_dedup, queries, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(n)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > n)


def plain_components(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in nodes}


def documents(seed=3, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 5, 300, 600]))]
        out.append((10 * i, " ".join(words)))
        if len(words) > 100:
            for k in range(3):
                near = list(words)
                near[rng.randrange(len(near))] = "changed"
                out.append((10 * i + k + 1, " ".join(near).replace("alpha", "ALPHA", k)))
    return out + [(5001, None), (5002, ""), (5003, " \t\n"), (5004, "É é"), (None, "alpha beta gamma"), (5005, out[0][1]), (5005, out[0][1])]


def test_near_duplicates_equal_the_plain_version(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.selectExpr("doc_id", "text", "'x' AS fingerprint", "1 AS component_id")
    prints = {(i, t): plain_fingerprint(t) for i, t in rows}
    roots = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    wanted = sorted(((i, simhash.signed(prints[i, t]), least.get(roots[prints[i, t]])) for i, t in rows), key=str)
    found = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert found == wanted
    renamed = simhash.near_duplicates(df.select("doc_id", "text").withColumnRenamed("doc_id", "fingerprint"), id_col="fingerprint")
    assert renamed.columns == ["fingerprint_id", "fingerprint", "component_id"]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # One row of each component stays; the one without an id only if its component has no other.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _, c in wanted if i == c), key=str)


#: Names that operators have inside, and those of results, as columns of their input.
TAKEN = ["_tw_maybe", "_tw_digest", "_tw_row", "_tw_name", "_tw_dropped", "_tw_slot", "_tw_bucket", "_tw_bits", "id", "text_sha256", "component_id", "fingerprint", "node", "line", "doc", "kept"]


def with_taken(df):
    return df.selectExpr("*", *(f"'{i}' AS {name}" for i, name in enumerate(TAKEN)))


SAME_ID = [(1, "one two three four five six\nshared line of words\n1"), (1, "quite another text it is\nshared line of words\n1"), (2, "ONE two three four five six\nshared line of words\n1"), (None, "no id here\nx y"), (None, "nor here\nx y")]


@pytest.mark.parametrize("options", [{"max_bits": 4}, {"by_similarity": True, "shingle_words": 5}])
def test_documents_with_the_same_id_are_told_apart(spark, options):
    df = with_taken(spark.createDataFrame(SAME_ID, "doc_id long, text string"))
    kept = simhash.drop_near_duplicates(df, **options)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == SAME_ID[:2]
    assert {r.text for r in kept.where("doc_id is null").collect()} == {SAME_ID[3][1], SAME_ID[4][1]}


def test_lines_of_documents_with_the_same_id_are_told_apart(spark):
    df = with_taken(spark.createDataFrame(SAME_ID, "doc_id long, text string"))
    left = line_dedup.without_lines(df)
    assert left.columns == df.columns
    lines = [x for r in left.collect() for x in r.text.split("\n")]
    every = [x.lower() for _, t in SAME_ID for x in t.split("\n")]
    assert sorted(x.lower() for x in lines if x) == sorted(set(every))
    report = line_dedup.line_report(df)
    assert report.count() == len(SAME_ID) and report.selectExpr("sum(size(dropped))").first()[0] == len(every) - len(set(every))


def test_exact_dedup_with_taken_names(spark):
    df = with_taken(spark.createDataFrame([*SAME_ID, (7, SAME_ID[0][1])], "doc_id long, text string"))
    kept = exact.drop_exact(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("7", SAME_ID[0][1]), ("1", SAME_ID[1][1]), *((str(None), t) for _, t in SAME_ID[3:])])
    for name in ("kept", "keep_id", "text_sha256", "GROUP_SIZE"):
        found = exact.groups(df.select("doc_id", "text").withColumnRenamed("doc_id", name), id_col=name)
        assert len(set(map(str.lower, found.columns))) == 5 and found.count() == 6


def test_registered_simhash_query_equals_the_plain_version(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    roots = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {tuple(r[:3]) for r in queries.op7_simhash(spark, data).collect()} == {(i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_hot_keys_are_dealt_out_without_loss(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (40, 2))}
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fingerprint long")
    found = {(a, b) for a, b in simhash.links(nodes, block=block).collect()}
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 4 for a, b in found)
    signed = [simhash.signed(p) for p in prints]
    own = plain_components(signed, lambda a, b: (min(a, b), max(a, b)) in {(min(x), max(x)) for x in found})
    all_links = plain_components(signed, lambda a, b: ((a & mask) ^ (b & mask)).bit_count() <= 4)
    assert own == all_links


def test_pivot_bound_is_below_the_distance():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    bound = np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max(axis=2).sum(axis=1)
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert exact.groups(none).count() == exact.drop_exact(none).count() == 0
    assert line_dedup.line_report(none).count() == 0


@pytest.mark.parametrize("bytes_", [4096, 256 << 20])
def test_exact_groups(spark, bytes_):
    rows = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "abc"), (7, "z"), (7, "Z"), (None, None)]
    rows += [(100 + i, f"text {i % 900}") for i in range(2000)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, kept int")
    lower = str.maketrans(exact.UPPER, exact.LOWER)
    by = {}
    for i, t in rows:
        by.setdefault((t or "").translate(lower), []).append(i)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in by.items()}
    wanted = sorted(((i, best[k], len(by[k]), i == best[k]) for i, t in rows for k in [(t or "").translate(lower)]), key=str)
    found = exact.groups(df, max_filter_bytes=bytes_).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == wanted
    stay = exact.drop_exact(df, max_filter_bytes=bytes_)
    assert stay.columns == df.columns
    assert sorted((r.doc_id for r in stay.collect()), key=str) == sorted(best.values(), key=str)


def plain_dropped(rows):
    def words(line):
        return line.encode().lower().split()

    places = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = tuple(words(line))
            if w:
                places.setdefault(w, []).append((i, n))
    out = set()
    for w, own in places.items():
        first = min(own)
        near = any(min(other) < first for v, other in places.items() if v != w and min(len(v), len(w)) >= 8 and line_dedup.within_one(list(v), list(w)))
        out |= {p for p in own if near or p != first}
    return out


def test_line_dedup_equals_the_plain_version(spark):
    rng = random.Random(4)
    pool = [[rng.choice(WORDS) for _ in range(rng.choice([2, 3, 7, 8, 9, 20]))] for _ in range(40)]

    def edited():
        words = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], [rng.choice(WORDS)]])
        return " ".join(words)

    rows = [(i, "\n".join(edited() for _ in range(rng.choice([1, 4, 9])))) for i in range(60)] + [(90, None), (91, ""), (92, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS line", "'x' AS doc").repartition(4)
    wanted = plain_dropped(rows)
    assert {tuple(r) for r in line_dedup.dropped_lines(df).collect()} == wanted
    report = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert len(report) == len(rows)
    assert all(set(report[i].dropped) == {n for d, n in wanted if d == i} for i, _ in rows)
    left = {r.doc_id: r.text for r in line_dedup.without_lines(df).collect()}
    for i, t in rows:
        assert left[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in wanted))


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "acb", False), ("", "a", True), ("ab", "", False)])
def test_within_one(a, b, near):
    assert line_dedup.within_one(list(a), list(b)) is near
