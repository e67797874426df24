"""URL templates of whole paths against a plain version of the method."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tieweave.llm import urls


def plain_templates(paths):
    """Template of each of ``paths`` (lists of segments, one for each URL of a host), by the module's rules, segment by segment."""
    count = Counter(map(tuple, paths))
    names = {p: () for p in count}
    longest = max((len(p) for p in count), default=0)
    for k in range(longest):
        children = defaultdict(Counter)
        for p, n in count.items():
            if len(p) > k:
                children[names[p][:k]][p[k]] += n
        for p in count:
            if len(p) > k:
                own = children[names[p][:k]]
                many = len(own) >= urls.VARIABLE_KINDS and urls.VARIABLE_SHARE * own[p[k]] <= sum(own.values())
                numbered = any(c in "0123456789" for c in p[k]) and len(own) >= 2
                names[p] += ("*" if many or numbered else p[k],)
    for k in range(longest - 1, 0, -1):
        nodes = defaultdict(lambda: defaultdict(Counter))
        for p, n in count.items():
            if len(p) >= k:
                nodes[names[p][: k - 1]][names[p][k - 1]]["/".join(names[p][k:])] += n
        merged = set()
        for node, branches in nodes.items():
            pooled = sum(branches.values(), Counter())
            whole = sum(pooled.values())
            for t, ways in branches.items():
                n = sum(ways.values())
                distance = sum(max(x / n - pooled[b] / whole, 0.0) for b, x in ways.items())
                alike = round(distance, 9) <= round(urls.MERGE_DISTANCE + 1 / math.sqrt(n), 9)
                if alike and len(branches) > 1 and 2 * sum(x for b, x in ways.items() if b) >= n:
                    merged.add((*node, t))
        for p in count:
            if len(p) >= k and names[p][:k] in merged:
                names[p] = (*names[p][: k - 1], "{}", *names[p][k:])
    return {p: "".join("/" + t for t in names[p]) for p in count}


def paths(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(300):
        kind = rng.randrange(4)
        if kind == 0:
            out.append(["en", "news", rng.choice(["sport", "spam"]), str(rng.randrange(40)), rng.choice("ab"), "print"])
        elif kind == 1:
            out.append(["shop", f"p{rng.randrange(9)}", rng.choice(["big", "small"]), *(rng.choice("xyz") for _ in range(rng.randrange(4)))])
        elif kind == 2:
            out.append([rng.choice(["a", "b", "c"]), *(rng.choice("de") for _ in range(rng.randrange(1, 7)))])
        else:
            out.append(["deep", *(f"s{rng.randrange(3)}" if k % 3 == 0 else "t" for k in range(rng.randrange(8)))])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_of_deep_paths_equal_the_plain_version(spark, seed):
    own = paths(seed)
    long = ["very", *(f"long{i}" for i in range(400))]
    own += [long, long, [*long[:2], "other"]]
    df = spark.createDataFrame([(i, "http://h.org/" + "/".join(p)) for i, p in enumerate(own)], "page_id long, url string")
    wanted = plain_templates(own)
    found = {r.page_id: r.template for r in urls.judged(df, []).collect()}
    assert all(found[i] == wanted[tuple(p)] for i, p in enumerate(own))


def test_levels_below_the_third_are_told_apart(spark):
    rows = [(i, f"http://a.org/en/news/sport/{k}/{v}") for i, (k, v) in enumerate((k, v) for k in ("good", "spam") for v in "abcdef")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumnRenamed("page_id", "path")
    rules = [urls.Rule(f"a.org/en/news/sport/spam/{v}", "block") for v in "abcde"] + [urls.Rule(f"a.org/en/news/sport/good/{v}", "allow") for v in "abcde"]
    found = urls.judged(df, rules, id_col="path")
    assert found.columns[:3] == ["path_id", "host", "path"]
    texts = {r.path.split("/", 4)[4]: r for r in found.collect()}
    assert texts["good/f"].template.startswith("/en/news/sport/") and "**" not in texts["good/f"].template
    assert {r.template.count("/") for r in texts.values()} == {5}
