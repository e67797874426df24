"""Language, chat, URLs and quality."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieweave.llm import chat, langid, quality, queries, urls


def test_gradients_are_the_slopes():
    net = langid.new_network(["a", "b"], 3, np.random.default_rng(1))
    net = langid.Network(net.languages, *(x.astype(np.float64) for x in net.parts))
    windows = np.random.default_rng(2).integers(97, 100, (5, 4))
    windows[4, 0] = langid.PADDING
    labels, weights = np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 1.0, 0.5])

    def loss():
        both = np.concatenate([langid.states(net, windows, d).astype(np.float64) for d in (0, 1)], axis=2)
        p = langid.softmax(both @ net.output + net.bias)
        own = -np.log(p[:, np.arange(4), labels])
        count = (windows != langid.PADDING) * weights
        return (own * count).sum() / count.sum()

    for part, slope in zip(net.parts, langid.gradients(net, windows, labels, weights)):
        at = tuple(np.unravel_index(np.abs(slope).argmax(), slope.shape))
        step, old = 1e-2, part[at]
        part[at] = old + step
        up = loss()
        part[at] = old - step
        down = loss()
        part[at] = old
        assert slope[at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=1e-4)


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(rows) == docs.count() and len(out) > 30
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_registered_language_query(spark, data):
    found = queries.op4_language_id(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    langs = {r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()} - {None}
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.lang_pred in langs if any(map(str.isalpha, texts[r.doc_id] or "")) else (r.lang_pred, r.score) == ("und", 0.0)


def test_language_of_odd_texts(spark):
    rows = [(1, "the quick brown fox " * 40, "en"), (2, "le renard brun et la " * 40, "fr"), (3, None, "en"), (4, "", "fr"), (5, "123 !?", None), (None, "the fox", "en"), (6, "x" * 500_000, None), (7, "½ ² Ⅷ _", None), (8, "Ж", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    found = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    assert {i: (found[i].lang_pred, found[i].score) for i in (3, 4, 5, 7)} == dict.fromkeys((3, 4, 5, 7), ("und", 0.0))
    assert found[8].lang_pred in ("en", "fr")
    assert langid.predict(df.withColumnRenamed("doc_id", "lang_pred"), None, id_col="lang_pred").columns == ["lang_pred_id", "lang_pred", "score"]
    assert langid.fit(df.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    kept = langid.keep_known(df, langid.fit(df), min_score=0.0)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 8, None}


def test_every_language_is_learnt_and_the_sample_is_bounded(spark):
    rows = [(i, f"wort{i % 70} " * 30, f"l{i % 70:02}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang"}
    found = langid.training_texts(df, **names, sample_rows=210)
    assert len(found) == 210 and len({lang for _, lang in found}) == 70
    assert len(langid.training_texts(df, **names, sample_rows=10)) == 70
    assert all(text.decode() == f"wort{int(lang[1:])} " * 30 for text, lang in found)


def test_forward_pass_equals_a_plain_loop():
    net = langid.new_network(["a", "b", "c"], 4, np.random.default_rng(4))
    text = "Sätze aus Bytes. ".encode() * 9

    def plain(part, direction):
        h, state, out = 4, np.zeros(4), {}
        for t in range(langid.WINDOW) if direction == 0 else range(langid.WINDOW - 1, -1, -1):
            given, u = net.inputs[direction][part[t]], net.recurrent[direction]
            update = 1 / (1 + np.exp(-(given[:h] + state @ u[:, :h])))
            reset = 1 / (1 + np.exp(-(given[h : 2 * h] + state @ u[:, h : 2 * h])))
            state = (1 - update) * state + update * np.tanh(given[2 * h :] + (reset * state) @ u[:, 2 * h :])
            out[t] = state
        return out

    total = np.zeros(3)
    for at in range(0, len(text), langid.WINDOW):
        part = [*text[at : at + langid.WINDOW]]
        size = len(part)
        part += [langid.PADDING] * (langid.WINDOW - size)
        forwards, backwards = plain(part, 0), plain(part, 1)
        for t in range(size):
            scores = np.exp(np.concatenate([forwards[t], backwards[t]]) @ net.output + net.bias)
            total += scores / scores.sum()
    assert np.allclose(langid.pooled(net, [text])[0], total / len(text), atol=1e-5)


def test_position_sums_do_not_depend_on_the_batch():
    net = langid.new_network(["a", "b", "c"], 4, np.random.default_rng(3))
    texts = [b"abc", b"x" * 64, b"y" * 65, b"hello world " * 30]
    alone = np.concatenate([langid.pooled(net, [t]) for t in texts])
    assert np.allclose(langid.pooled(net, texts), alone, atol=1e-6)
    assert np.allclose(alone.sum(axis=1), 1, atol=1e-5)


def test_snapshots_collapse(spark):
    def log(conv, *texts):
        return [(conv, n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]

    rows = log(1, "hi") + log(2, "hi", "yes?") + log(3, "hi", "yes?", "bye") + log(4, "hi", "no") + log(5, "hi", "yes?", "bye") + log(6, "alone")
    rows += [(None, None, None, None), (7, 0, "user", None), (8, 1, "user", ""), (9, 0, "use", "rhi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS copies").repartition(3)
    found = chat.segments(df).collect()
    assert {(r.conv_id, r.n_turns, r.copies) for r in found} == {(3, 3, 2), (4, 2, 1), (6, 1, 1), (None, 1, 1), (7, 1, 2), (9, 1, 1)}
    assert [r.segment for r in sorted(found, key=lambda r: r.position) if r.conv_id == 4] == ["<|user|>\nhi<|end|>\n", "<|assistant|>\nno<|end|>\n"]
    whole = {r.conv_id: r.text for r in chat.documents(chat.segments(df)).collect()}
    assert whole[4] == "<|user|>\nhi<|end|>\n<|assistant|>\nno<|end|>\n"
    assert chat.segments(df.limit(0)).count() == 0


def plain_conversations(rows):
    """(conv_id, n_turns, copies, segments) of the maximal conversations, by their whole turns."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    whole = {}
    for conv, own in by.items():
        whole.setdefault(tuple((r, t) for _, r, _, t in sorted(own)), []).append(conv)
    starts = {turns[:k] for turns in whole for k in range(1, len(turns))}
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return {least(ids): (len(turns), len(ids), [f"<|{r}|>\n{t}<|end|>\n" for r, t in turns]) for turns, ids in whole.items() if turns not in starts}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_long_conversations_and_repeated_turns_equal_the_plain_version(spark, partitions):
    rng = random.Random(8)
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"text {n}") for n in range(900)]
    rows += [(2, n, r, t) for _, n, r, t in rows[:700]] + [(3, n, r, t) for _, n, r, t in rows[:700]]
    rows += [(4, 0, "user", "same")] * 300 + [(5, 0, "user", "same")] * 200 + [(None, None, None, None)] * 40 + [(None, 3, "user", "x" * 200_000)]
    rows += [(100 + i, n, "user", rng.choice("ab")) for i in range(60) for n in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS conv", "3 AS part", "4 AS position").repartition(5)
    wanted = plain_conversations(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = chat.segments(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = {}
    for r in sorted(found, key=lambda r: r.position):
        own.setdefault((r.conv_id, r.n_turns, r.copies), []).append(r.segment)
    assert own == {(i, n, c): s for i, (n, c, s) in wanted.items()}


RULES = [urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"), urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow")]


def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/"), (2, "http://net/x", "net", "/x", "net/"), (3, "http://a.net", "a.net", "", None),
        (4, "https://planet/x#f", "planet", "/x", None), (5, None, "", "", None), (6, "no scheme", "", "", None), (7, "x://a://b/c", "a:", "//b/c", None),
        (8, "http://sub.example.com/de/1/2/3/4/5", "sub.example.com", "/de/1/2/3/4/5", "example.com/de/"), (9, "http://É.org/fr/", "É.org", "/fr/", "org/fr/"), (9, "http://É.org/fr/", "É.org", "/fr/", "org/fr/"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS n")
    found = sorted(((r.page_id, r.host, r.path, r.rule) for r in urls.judged(df, RULES).collect()), key=str)
    assert found == sorted(((r[0], *r[2:]) for r in rows), key=str)
    assert urls.judged(df.limit(0), RULES).count() == 0


def test_templates_and_purity(spark):
    pages = [f"http://bad.example.com/de/{i}" for i in range(30)] + [f"http://bad.example.com/en/{i}" for i in range(30)]
    pages += [f"http://good.example.com/de/{i}" for i in range(3)] + [f"http://good.example.com/en/{i}" for i in range(90)] + [f"http://other.example.com/about/{i}x/deep" for i in range(4)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    found = {r.page_id: r for r in urls.judged(df, RULES).collect()}
    assert {found[i].template for i in range(60)} == {"/{}/*"}
    assert {found[i].verdict for i in range(30, 60)} == {"block"}
    assert {found[i].verdict for i in range(63, 153)} == {"allow"}
    assert found[153].template == "/about/*/deep"


@pytest.mark.parametrize(
    ("line", "failure"),
    [
        ("Home | News | About", "navigation"), ("bad### words%%% here&&&", "symbols"), ("WIN NOW AND HERE!!", "shouting"), ("Please ACCEPT  cookies to go on.", "boilerplate"),
        ("a short line", "unfinished"), ("A short line.", None), ('He said "so."', None), ("one two three four five six seven eight nine ten eleven twelve", None),
    ],
)
def test_line_rules(line, failure):
    known = {quality.line_hash(b"please accept cookies to go on.".split())}
    assert quality.line_failure(line, line.encode().split(), known) == failure


def test_boilerplate_is_found_by_its_neighbours(spark):
    def page(i, *inside):
        return "\n".join([f"This{i} page{i} begins{i}.", *inside, "", f"And{i} here{i} it{i} ends{i}."])

    long = " ".join(f"w{k}" for k in range(quality.BOILERPLATE_WORDS + 1)) + "."
    rows = [page(i, f"Eigen{i}.", "Alle Rechte\tvorbehalten.", long) for i in range(12)]
    rows += ["A first line.\nA copied line.\nA last line." + f"\nEdit {i}." * (i % 3 == 0) for i in range(30)]
    rows += [page(100 + i, "Not often.") for i in range(9)] + [None, "", " \n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, line string").repartition(3)
    found = {r.line for r in quality.boilerplate_lines(df).collect()}
    # The unfinished page marks at the ends of a text have neighbours of their own.
    assert found == {quality.line_hash(b"alle rechte vorbehalten.".split())}
    assert quality.boilerplate_lines(df.limit(0)).count() == 0
    texts = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert texts[0].lost_words == 3 and texts[12].lost_words == 0


def test_very_long_texts_are_judged_whole(spark):
    sentence = "Many different words stand in line number {} of this very long text, so it stays."
    whole = "\n".join(sentence.format(i) for i in range(30_000))
    df = spark.createDataFrame([(1, whole), (2, whole + "\n" + "A | B\n" * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert found[1].n_words == 16 * 30_000 and found[2].lost_words == 600_000
    assert found[2].kept is False


@pytest.mark.parametrize("name", ["kept", "n_words", "LOST_WORDS"])
def test_quality_ids_may_have_any_name(spark, name):
    df = spark.createDataFrame([(1, "a b")], f"{name} long, text string")
    assert quality.verdicts(df, id_col=name).first()[0] == 1


def test_quality_against_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.verdicts(docs).join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q and r.n_words >= quality.MIN_WORDS] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_repeated_words_equal_the_plain_count():
    rng = np.random.default_rng(6)
    for n in (0, 1, 3, 4, 5, 50, 400):
        words = [b"%d" % x for x in rng.integers(0, 6, n)]
        windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert quality.repeated_words(words) == len(covered)


def test_documents_that_lose_too_much_go(spark):
    good = "\n".join(f"The{i} fine{i} sentence{i} has quite{i} unlike{i} words{i}." for i in range(12))
    bad = good + "\n" + "\n".join(f"Menu{i} | Item{i} | Other{i} | More{i} | Last{i} | a{i} b{i} c{i}" for i in range(30))
    some = good + "\nHome | News | About"
    rows = [(1, good, 5), (2, bad, 5), (3, some, 5), (4, None, 5), (5, "", None), (5, "short.", None), (None, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'k' AS kept", "1 AS n_words")
    found = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert {i: r.kept for i, r in found.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, None: True}
    clean = {r.doc_id: r for r in quality.clean(df).collect()}
    assert set(clean) == {1, 3, None} and clean[3].text == good and clean[3].n_chars == len(good) and clean[1].n_chars == 5


def test_boilerplate_by_join_gives_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("*", "1 AS line", "2 AS key")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    pages = spark.range(12).selectExpr("id doc_id", "concat('Page ', id, repeat(' begins with words', 30), '.\\nAll rights are reserved here.\\nPage ', id, ' ends.') text")
    docs = docs.unionByName(pages, allowMissingColumns=True)
    assert quality.boilerplate_lines(docs).count() > 0
    assert sorted(quality.verdicts(docs, most_broadcast=0).collect(), key=str) == sorted(quality.verdicts(docs).collect(), key=str)
    assert sorted(quality.clean(docs, most_broadcast=0).collect(), key=str) == sorted(quality.clean(docs).collect(), key=str)


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    own = [(i, f"Page {i} begins here with some words of its own.\nAll rights are reserved here.\nPage {i} ends here with some words.") for i in range(10)]
    others = [(1000 + i, "\n".join(f"Line {k} of text {i} says nothing new." for k in range(30))) for i in range(900)]
    few = spark.createDataFrame(own, "doc_id long, text string")
    many = spark.createDataFrame(own + others, "doc_id long, text string")
    lost = lambda df: {r.doc_id: (r.lost_words, r.kept) for r in quality.verdicts(df).where("doc_id < 1000").collect()}
    assert lost(few) == lost(many) and lost(few)[0][0] == 5


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, "wort " * (20 + i % 50), "de" if i % 3 else "en") for i in range(600)] + [(1000 + i, "lang " * 50_000, "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.training_texts(df, id_col="doc_id", text_col="text", lang_col="lang", sample_rows=400, sample_bytes=20_000)
    size = {lang: sum(len(t) for t, x in found if x == lang) for lang in ("de", "en")}
    assert all(8_000 < n <= 10_000 for n in size.values()) and max(len(t) for t, _ in found) < 1000
    assert langid.training_texts(df, id_col="doc_id", text_col="text", lang_col="lang", sample_bytes=2) == []


def test_language_of_ties_and_repeated_rows(spark):
    rows = [(1, "the same text", "en"), (1, "the same text", "en"), (2, "the same text", "fr"), (None, "the same text", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(df, langid.fit(df)).collect()
    assert len(found) == 12 and len({(r.lang_pred, r.score) for r in found}) == 1
    # Equal probabilities: the first language in order.
    net = langid.new_network(["aa", "bb"], 2, np.random.default_rng(0))
    for x in net.parts:
        x[...] = 0
    assert {(r.lang_pred, r.score) for r in langid.predict(df, net).collect()} == {("aa", 0.5)}
