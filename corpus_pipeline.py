"""A training corpus from ``documents``: clean, known language, no copies, packed.

``STAGES`` are applied in order. Each takes (spark, docs, sf_dir) and works on all rows
that the stage before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tieweave.llm import exact, langid, packing, quality, simhash
from tieweave.llm.common import scratch_path, table

#: A mean probability below this for the best of four languages is no decision.
MIN_LANGUAGE_SCORE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failed lines.

    A null, empty or blank text is rejected, as it has under 50 words. A very long text is
    judged whole. Repeated rows and rows with a null id are judged each on their own, so
    there are no ties. An empty table gives an empty one. Other columns stay, whatever
    their names and whatever nulls they have; ``n_chars`` follows the text where a line went.
    """
    return quality.clean(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a clear language go.

    A null or empty text has no letter. Rows with a null language are not learnt from but
    judged like any other; without any language to learn, all rows go. A very long text
    is read whole. Of equal probabilities the first language in order counts. Repeated rows
    and rows with a null id are judged each on their own. An empty table gives an empty
    one. Other columns stay, whatever their names.
    """
    return langid.keep_known(docs, langid.fit(docs), min_score=MIN_LANGUAGE_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (A-Z in lower case; null as empty).

    It is the one with the largest id, a null id being the least; of rows with one id, the
    one with the largest hash over its columns; of rows equal in all columns, any. A very
    long text is hashed whole. An empty table gives an empty one. Other columns stay,
    whatever their names.
    """
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a 5-word similarity of 0.8 stays.

    It is the one with the least id, null being the last; of rows with one id, the one with
    the least hash of its text; rows equal in id and text stay or go together. Null, empty
    and blank texts are one component. Very long texts are compared whole. An empty table
    gives an empty one. Other columns stay, whatever their names.
    """
    return simhash.drop_near_duplicates(docs, shingle_words=5, by_similarity=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left, with their token ids.

    A null or empty text is its end id alone, a very long one as many sequences as it
    takes; repeated rows and rows with a null id are packed each on their own; an empty
    table gives no sequences. Other columns are not read, whatever their names.
    """
    return packing.pack_powers_of_two(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pack", pack),
]

#: SQL can't express the network and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
