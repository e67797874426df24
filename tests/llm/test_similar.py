"""Near copies by exact similarity against brute force."""

import random

import corpus_pipeline
import numpy as np

from tieweave.llm import similar, simhash


def jaccard(a: str, b: str) -> float:
    x, y = (set(similar.shingles(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def copies(n_groups: int, per_group: int, changes: int) -> list[tuple[int, str]]:
    rng = random.Random(5)
    rows = []
    for g in range(n_groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 160))]
        for _ in range(per_group):
            own = list(words)
            for _ in range(rng.randrange(changes + 1)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(own)))
    return rows


def least(rows: list[tuple[int, str]]) -> dict[int, int]:
    root = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if root[i] != root[j] and jaccard(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    return root


def test_components_equal_brute_force(spark):
    rows = copies(12, 9, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (similar.BLOCK, 2):
        assert dict(similar.near_copies(df, block=block).collect()) == least(rows)


def test_stage_takes_five_words_and_four_fifths(spark):
    rows = copies(40, 2, 4)
    pairs = list(zip(rows[::2], rows[1::2]))
    bits = lambda p: (simhash.fingerprint(p[0][1]) ^ simhash.fingerprint(p[1][1])).bit_count()
    assert any(jaccard(a[1], b[1]) >= 0.8 and bits((a, b)) > simhash.MAX_BITS for a, b in pairs)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for (i, a), (j, b) in pairs:
        assert i in kept and (j in kept) == (jaccard(a, b) < 0.8)


def test_linked_equals_plain_comparison():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 6000)
    sets = [np.unique(np.concatenate([base[rng.random(6000) < 0.93], rng.integers(0, 1 << 60, 200)])) for _ in range(8)]
    sets += [rng.integers(0, 1 << 60, 50) for _ in range(3)]
    alike = {(i, j) for i in range(11) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    edges = similar.linked(sets, np.arange(11))
    assert edges and {(j, i) for i, j in edges} <= alike
    joined = {x for e in edges for x in e}
    assert joined == {x for e in alike for x in e}
    assert similar.linked(sets, np.zeros(11, dtype=np.int64)) == []


def test_blank_null_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (None, "one two"), (5, "One  two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(similar.near_copies(df).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df, by_similarity=True).collect()) == [1, 4]
    assert similar.near_copies(df.limit(0)).count() == 0


def test_near_dedup_uses_the_pivot_tables(spark, monkeypatch):
    """The stage hands on what the fingerprints link as candidates."""
    long = [f"w{i}" for i in range(400)]
    near = [*long[:-1], "other"]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(f"x{i}" for i in range(400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = similar.signatures(df, id_col="doc_id").select("node", "fingerprint")
    assert simhash.meeting(prints).count() == 1
    kept = lambda: sorted(r.doc_id for r in simhash.drop_near_duplicates(df, shingle_words=5, by_similarity=True).collect())
    assert kept() == [1, 3]
    without, seen = similar.near_copies, []
    monkeypatch.setattr(similar, "near_copies", lambda docs, meet, **names: (seen.append(meet), without(docs, meet=meet, **names))[1])
    assert kept() == [1, 3] and seen[0] is not None
