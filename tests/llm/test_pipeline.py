"""The pipeline and the registered queries of this subpackage."""

import corpus_pipeline
import pytest
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

from tieweave.llm import queries
from tieweave.llm.common import checkpointed


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, data))
        assert docs.columns == columns, name
        assert docs.count() <= n
        n = docs.count()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept


def test_clean_labelled_documents_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, data)
    long = docs.where("size(split(text, ' ')) >= 60").join(labels, "doc_id")
    good, bad = long.where("quality = 1 and toxic = 0"), long.where("quality = 0")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.03 * good.count()
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.2 * bad.count()


def sentence(*key):
    return " ".join("word" + "x".join(map(str, (*key, k))) for k in range(14)) + "."


CLEAN = ["\n".join(sentence(d, i) for i in range(9)) for d in range(6)]
LONG = "\n".join(sentence("long", i) for i in range(15_000))
#: Names that stages and operators have inside, and those of their results.
TAKEN = ["_tw_digest", "_tw_maybe", "_tw_slot", "_tw_bits", "_tw_row", "_tw_name", "kept", "component_id", "fingerprint", "start", "length", "ids", "sequence_id", "bucket", "node", "id"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, one id for two texts, and clashing names."""
    rows = [(1, CLEAN[0], "en", "a", 5), (2, CLEAN[1], "en", None, None), (3, CLEAN[1].replace("w", "W"), None, "b", 7), (None, CLEAN[2], "en", "a", 1), (None, CLEAN[3], None, "a", 1)]
    rows += [(4, CLEAN[4], "fr", "c", 1)] * 2 + [(4, CLEAN[5], "fr", "c", 1), (5, LONG, "en", "a", 1), (6, CLEAN[0].replace("word0x4x3", "other"), "en", "a", 2)]
    rows += [(7, None, "en", "a", None), (8, "", "en", "a", 0), (9, " \n\t", None, None, 3), (None, None, None, None, None), (10, "½ 123 !?", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return checkpointed(df.selectExpr("*", *(f"'{i}' AS {name}" for i, name in enumerate(TAKEN))).repartition(3))


def kept_of(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_quality_stage_on_odd_rows(spark, odd):
    kept = corpus_pipeline.quality_rules(spark, odd, "")
    assert kept.columns == odd.columns
    assert kept_of(kept) == kept_of(odd.where("length(text) > 100"))


def test_language_stage_on_odd_rows(spark, odd):
    kept = corpus_pipeline.language(spark, odd, "")
    assert kept.columns == odd.columns
    lost = {r.text for r in odd.collect()} - {r.text for r in kept.collect()}
    assert {None, "", " \n\t", "½ 123 !?"} <= lost
    assert corpus_pipeline.language(spark, odd.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_exact_stage_on_odd_rows(spark, odd):
    kept = corpus_pipeline.exact_dedup(spark, odd, "")
    assert kept.columns == odd.columns
    own = [(str(r.doc_id), r.text) for r in odd.collect()]
    wanted = {}
    for i, text in own:
        key = (text or "").lower() if (text or "").isascii() else text
        wanted.setdefault(key, []).append((-1 if i == "None" else int(i), i, text))
    assert kept_of(kept) == sorted((i, t) for _, i, t in (max(x, key=lambda y: y[0]) for x in wanted.values()))


def test_near_stage_on_odd_rows(spark, odd):
    kept = corpus_pipeline.near_dedup(spark, odd, "")
    assert kept.columns == odd.columns
    texts = [CLEAN[0], CLEAN[1], CLEAN[2], CLEAN[3], CLEAN[4], CLEAN[4], CLEAN[5], LONG, None, "½ 123 !?"]
    assert sorted(map(str, texts)) == sorted(str(r.text) for r in kept.collect())
    assert {str(r.doc_id) for r in kept.where("text is null").collect()} == {"7"}


def test_pack_stage_on_odd_rows(spark, odd):
    found = corpus_pipeline.pack(spark, odd, "")
    assert len({r.sequence_id for r in found.collect()}) == found.count()
    whole = found.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert all(r.n % r.doc_tokens == 0 for r in whole)
    assert found.where("doc_tokens = 1").count() == 3


def test_stages_on_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.limit(0), "")
        assert out.count() == 0, name
        assert name == "pack" or out.columns == odd.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    assert spark_rows(queries.queries()[name](spark, data)) == sql_rows(queries.oracle_sql()[name], data)
