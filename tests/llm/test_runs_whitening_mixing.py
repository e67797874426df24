"""Periodic runs, whitening and mixing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tieweave.llm import mixing, periodic, queries, whitening


def plain_runs(words, min_length=6, min_exponent=4):
    """All runs by trying every period from every place."""
    n, found = len(words), {}
    for period in range(1, n // min_exponent + 1):
        start = 0
        while start + period < n:
            end = start + period
            while end < n and words[end] == words[end - period]:
                end += 1
            if end - start >= max(min_length, min_exponent * period):
                found.setdefault((start, end), period)
            start = end - period + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_plain_ones(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 60 + 5 * seed:
        block = [rng.choice("abc"[: 1 + seed % 3]) for _ in range(rng.randint(1, 9))]
        words += (block * rng.randint(1, 7))[: rng.randint(1, 60)]
    codes = periodic.word_codes([w.encode() for w in words])
    assert periodic.find_runs(codes) == plain_runs(words)
    assert periodic.find_runs(codes, 3, 2) == plain_runs(words, 3, 2)


def test_runs_survive_clashing_hashes(monkeypatch):
    words = list("abababababababacababab" * 4 + "x" * 30 + "abcabcabcabcabd" * 3)
    codes = periodic.word_codes([w.encode() for w in words])
    monkeypatch.setattr(periodic, "BASE", np.uint64(1 << 62))  # all but the first words of a stretch count for nothing
    assert periodic.find_runs(codes) == plain_runs(words)
    # A Thue-Morse text has clashes for any base modulo a power of two.
    monkeypatch.undo()
    morse = [bin(i).count("1") % 2 for i in range(1 << 13)] * 5
    found = periodic.find_runs(np.array(morse))
    assert (0, len(morse), 1 << 13) in found and all(length >= 4 * p for _, length, p in found)


def test_long_and_small_blocks_of_pairs(monkeypatch):
    rng = random.Random(7)
    words = [rng.choice("ab") for _ in range(400)] + list("abc") * 50 + ["z"] * 90
    whole = periodic.find_runs(periodic.word_codes([w.encode() for w in words]))
    monkeypatch.setattr(periodic, "PAIRS", 10)
    assert periodic.find_runs(periodic.word_codes([w.encode() for w in words])) == whole == plain_runs(words)
    assert periodic.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def test_registered_runs_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.op11_periodic_runs(spark, data).collect()}
    assert set(found) == set(texts)
    some = 0
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                planted[i] = words[a + (i - a) % p]
            words = planted
        if n > 1500:
            continue  # the plain version is quadratic
        runs = plain_runs(words)
        row = found[doc]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{x},{p}\n" for s, x, p in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_runs_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n", 2), (4, "a " * 50_000 + "end", 2), (4, "a b " * 9, 3), (None, "x y " * 6, 3), (None, "x " * 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic.periodic_runs(df).collect()
    got = sorted(((r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str)
    want = [(0, [], "")] * 3 + [(50_001, [(0, 50_000, 1)], "a end"), (18, [(0, 18, 2)], "a b"), (6, [(0, 6, 1)], "x y"), (5, [], "x x x x x")]
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    assert periodic.periodic_runs(df.select("runs", "text"), id_col="runs").columns == ["runs_id", "n_words", "runs", "collapsed"]
    assert periodic.with_planted_runs(df.where("doc_id is null")).count() == 2


def plain_whitening(vectors, scale=256):
    x = np.floor(scale * np.array(vectors, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    about = fit - sums / n
    values, axes = np.linalg.eigh(about.T @ about / n)
    return x, n, sums, values[::-1], axes[:, ::-1]


def test_whitening_equals_numpy(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    x, n, sums, values, axes = plain_whitening([r.embedding for r in rows])
    found = queries.op12_whitening(spark, data).collect()
    at = {r.vec_id: i for i, r in enumerate(rows)}
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {n}
    for k in range(1, 5):
        own = [r for r in found if r.component == k]
        index = [at[r.vec_id] for r in own]
        want = (x[index] - sums / n) @ axes[:, k - 1] / np.sqrt(values[k - 1])
        got = np.array([r.whitened for r in own])
        assert np.abs(got - want * np.sign(want @ got)).max() < 1e-6
        assert [r.explained for r in own] == pytest.approx([values[k - 1] / values.sum()] * len(own), rel=1e-9)
        assert [r.deviation for r in own] == [int(sum(int(v) ** 2 for v in n * x[i] - sums)) for i in index]
    (error,) = {r.identity_error for r in found}
    assert 0 <= error < 1e-9


@pytest.mark.parametrize("size", [1, 10**6, 2**31, 2**55, 2**62])
def test_block_scatter_is_exact(size):
    rng = np.random.default_rng(3)
    x = rng.integers(-size, size, (50, 4)) + size // 2
    sums, products = whitening.block_scatter(x)
    big = [[int(v) for v in row] for row in x]
    assert sums.tolist() == [sum(r[j] for r in big) for j in range(4)]
    assert products.tolist() == [[sum(r[i] * r[j] for r in big) for j in range(4)] for i in range(4)]
    for number in (0, 1, -1, 2**32, -(2**70) + 5):
        assert sum(limb << (32 * k) for k, limb in enumerate(whitening.limbs(number))) == number


def test_scatter_over_tasks_is_exact(spark):
    rng = random.Random(1)
    x = [[rng.randint(-(2**62), 2**62) for _ in range(3)] for _ in range(200)]
    n, sums, products = whitening.scatter(spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(7), 3)
    assert (n, sums) == (200, [sum(r[j] for r in x) for j in range(3)])
    assert products == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2], 0), (2, [0.5, -0.25], 0), (2, [0.5, -0.25], 1), (None, [-0.75, 1.0], 0), (3, None, 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0], 0), (8, [], 0)]
    rows += [(100 + i, [0.1, 0.2], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    found = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in found if r.vec_id is None or r.vec_id < 100) == {1: 2, 2: 4, None: 2}
    assert {r.n for r in found} == {3} and {r.component for r in found} == {1, 2} and len(found) == 2 * 304
    assert sum({r.component: r.explained for r in found}.values()) == pytest.approx(1)
    assert max(r.identity_error for r in found) < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id >= 100")).collect() == []
    assert whitening.whiten(df.where("vec_id = 8")).collect() == []
    far = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0])], "vec_id long, embedding array<double>")
    assert [r.component for r in whitening.whiten(far).collect()] == [1, 1]
    assert whitening.whiten(df.withColumnRenamed("vec_id", "component"), id_col="component").columns[0] == "component_id"


def plain_targets(words, most=3):
    """By rounds, as the rule says: what a source leaves is shared among the others."""
    order = sorted(words, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stopped = sum(words.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left, share = total - sum(stopped.values()), sum(weight[s] for s in free)
        goals = {s: Fraction(left * weight[s], share) for s in free}
        above = [s for s in free if goals[s] > most * words[s]]
        if not above:
            return {s: float(g) for s, g in (stopped | goals).items()}
        stopped |= {s: most * words[s] for s in above}


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_those_by_rounds(spark, seed):
    rng = random.Random(seed)
    words = {f"s{i:03}": rng.choice([0, 1, 5, 40, 1000, 10**12]) for i in range(60 - 25 * seed)} | {None: 7, "": 3, "é": 9}
    df = spark.createDataFrame(list(words.items()), "source string, words long")
    found = {r.source: float(Fraction(int(r.over), int(r.under))) for r in mixing.targets(df).collect()}
    assert found == pytest.approx(plain_targets(words))
    assert sum(found.values()) == pytest.approx(sum(words.values()))


def test_registered_mixing_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    words = defaultdict(int)
    for doc, n in size.items():
        words[source[doc]] += n
    goals = plain_targets(words)
    found = queries.op13_source_mixing(spark, data).collect()
    assert sorted(found) == sorted(queries.op13_source_mixing(spark, data).collect())  # reruns agree
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        own = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], words[own]) and r.target == pytest.approx(goals[own])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[own] += r.taken
        largest[own] = max(largest[own], r.size)
    assert len(found) == len(docs) and all(abs(taken[s] - goals[s]) <= largest[s] for s in goals)


def test_mixing_of_odd_rows(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, None, None, 2), (3, "", "y", 3), (None, "w " * 70_000, "y", 4), (4, "one", None, None)]
    rows += [(None, "same text", "hot", 5)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").selectExpr("*", "1 AS words", "2 AS _tw_row")
    plan = mixing.plan(df).collect()
    assert len(plan) == len(rows) and all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in plan)
    assert {r.target for r in plan if r.source_size == 80} == {240.0}
    mix = mixing.mixed(df)
    got = Counter((r.doc_id, r.text) for r in mix.collect())
    assert mix.columns == df.columns and sum(got.values()) == sum(r.copies for r in plan) and got[None, "same text"] == 120
    assert mixing.plan(df.limit(0)).collect() == [] and mixing.mixed(df.limit(0)).collect() == []
    blank = mixing.plan(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in blank] == [(0, 0, 0.0, 0)] * 2
    assert mixing.plan(df.drop("words").withColumnRenamed("doc_id", "size"), id_col="size").columns[0] == "size_id"
