"""Quality rules, line first.

Every line is judged on its own. It fails as
- navigation: at least one in five of its words' worth of separators ``|<>``;
- symbols: more than one character of ``#*$%&|<>`` for five words;
- shouting: three words or more and no lower-case letter;
- boilerplate: its words stand in many places between ever different lines (below);
- unfinished: fewer than SHORT_LINE words and no end punctuation.
Failed lines are removed. A document is rejected if it fails the base rules (fewer than
50 words, or over half of the words in repeated 3-word windows), or if more than
MAX_LOSS of its words were in removed lines. Lines without a word count for nothing.

Boilerplate is what the documents show it to be, in any language: a line of at most
BOILERPLATE_WORDS words (A-Z in lower case) that stands in MIN_PLACES places or more, however
many lines there are, and of whose lines before or lines after at least three in four
differ from one another. Lines of a document that was copied, also with
changes here and there, keep their neighbours and so are no boilerplate.

The rules need one pass for the lines' hashes, which are counted over all documents, and
one to judge. Hashes of single lines are shuffled, never texts; a line that stands
everywhere is one row for each task, and its neighbours are dealt out by their own hashes.
The hashes of boilerplate lines are a table. Up to MOST_BROADCAST of them, 8 bytes each, are
broadcast; more are joined to the lines of each text by hash, with the same verdicts. Repeated
windows are found by sorting word numbers, so memory is in proportion to one text.

Defined results: a null text has no words and fails the base rules, as does an empty
one; a very long text is judged whole; repeated rows and null ids are judged each on their
own; an empty table gives no rows; other columns pass through ``clean`` untouched and are
not read by ``verdicts``, where an id column that has the name of a result comes back
with ``_id`` after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_name, scratch_path, slices

MIN_WORDS = 50
MAX_LOSS = 0.3
SHORT_LINE = 12
SPACE = " \t\n\r\x0b\x0c"
CLOSERS = "\"'”’»)]"
ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？", "।", "؟")
BOILERPLATE_WORDS = 40
MIN_PLACES = 10
MOST_BROADCAST = 1_000_000
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SEPARATORS = re.compile(r"[|<>]")




def line_hash(words: list[bytes]) -> int:
    """A signed hash of a line's words, A-Z in lower case."""
    from xxhash import xxh3_64_intdigest

    own = xxh3_64_intdigest(b" ".join(words).lower())
    return own - (1 << 64) if own >> 63 else own


def line_failure(line: str, words: list[bytes], boilerplate: set[int] | frozenset[int] = frozenset()) -> str | None:
    """The rule that a line with these words fails, or None. boilerplate: hashes of such lines."""
    n, symbols = len(words), len(_SYMBOLS.findall(line))
    if symbols:
        if 5 * len(_SEPARATORS.findall(line)) >= n:
            return "navigation"
        if 5 * symbols > n:
            return "symbols"
    if n >= 3 and line.isupper():
        return "shouting"
    if boilerplate and n <= BOILERPLATE_WORDS and line_hash(words) in boilerplate:
        return "boilerplate"
    if n < SHORT_LINE and not line.rstrip(SPACE).rstrip(CLOSERS).endswith(ENDS):
        return "unfinished"
    return None


def placed_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(line, before, after): hashes of each line of BOILERPLATE_WORDS words at most and its neighbours with a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = line_hash([])
        for batch in batches:
            for part in slices(batch, 0):
                hashes, short = [edge], [False]
                for text in part.column(0).to_pylist():
                    for words in worded_lines(text):
                        hashes.append(line_hash(words))
                        short.append(len(words) <= BOILERPLATE_WORDS)
                    hashes.append(edge)
                    short.append(False)
                own, at = np.array(hashes, dtype=np.int64), np.flatnonzero(short)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[at - 1]), pa.array(own[at + 1])], names=["line", "before", "after"])

    return docs.select(text_col).mapInArrow(run, "line long, before long, after long")


def worded_lines(text: str | None) -> Iterator[list[bytes]]:
    """The words of each line that has one."""
    return filter(None, (line.encode().split() for line in (text or "").split("\n")))


def boilerplate_lines(docs: DataFrame, *, text_col: str = "text", min_places: int = MIN_PLACES) -> DataFrame:
    """(line): the hashes of the lines that are boilerplate among ``docs``, as a written table."""
    spark = docs.sparkSession
    path = scratch_path(spark, "placed-lines")
    placed_lines(docs, text_col).write.parquet(path)
    lines = spark.read.parquet(path)
    often = lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_places)
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("other")) for k, c in enumerate(("before", "after"))))).alias("at")
    kinds = lines.join(often, "line").select("line", "n", sides).select("line", "n", "at.side", "at.other").distinct()
    most = kinds.groupBy("line", "n", "side").agg(F.count("*").alias("kinds")).groupBy("line", "n").agg(F.max("kinds").alias("kinds"))
    path = scratch_path(spark, "boilerplate")
    most.where(4 * F.col("kinds") >= 3 * F.col("n")).select("line").write.parquet(path)
    return spark.read.parquet(path)


def _with_boilerplate(docs: DataFrame, text_col: str, most_broadcast: int) -> tuple[DataFrame, str, Broadcast]:
    """``docs`` with a column, and its name, of the boilerplate lines of each text, or null where the broadcast set has all lines."""
    spark = docs.sparkSession
    key, marks = fresh(docs, "text_key", "boilerplate")
    lines = boilerplate_lines(docs, text_col=text_col)
    if lines.count() <= most_broadcast:
        known = spark.sparkContext.broadcast(lines.toArrow().column(0).to_numpy())
        return docs.withColumn(marks, F.lit(None).cast("array<bigint>")), marks, known

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [{line_hash(w) for w in worded_lines(t) if len(w) <= BOILERPLATE_WORDS} for t in part.column(1).to_pylist()]
                owners = np.repeat(np.arange(len(found)), [*map(len, found)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners)), pa.array([x for own in found for x in own], pa.int64())], names=["key", "line"])

    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    own = keyed.select(key, text_col).mapInArrow(run, "key string, line long").join(lines, "line", "left_semi")
    own = own.groupBy(F.col("key").alias(key)).agg(F.collect_set("line").alias(marks))
    joined = keyed.join(own, key, "left").withColumn(marks, F.coalesce(marks, F.array().cast("array<bigint>")))
    return joined.select(*docs.columns, marks), marks, spark.sparkContext.broadcast(np.zeros(0, dtype=np.int64))


def _judged(part: pa.RecordBatch, text_at: int, marks_at: int, known: set[int], max_loss: float) -> list[Judged]:
    both = zip(part.column(text_at).to_pylist(), part.column(marks_at).to_pylist())
    return [judge(t, known if own is None else set(own), max_loss=max_loss) for t, own in both]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    size = len(numbers)
    _, pair = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


@dataclass
class Judged:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    lost_words: int
    kept: bool
    text: str


def judge(text: str | None, boilerplate: set[int] | frozenset[int] = frozenset(), *, max_loss: float = MAX_LOSS) -> Judged:
    """All counts and the verdict on one text; ``text`` of the result has no failed line."""
    text = text or ""
    n = chars = lost = with_words = 0
    seen, left, words = set(), [], []
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            with_words += 1
            seen.add(line)
            words += own
            if line_failure(line, own, boilerplate):
                lost += len(own)
                continue
        left.append(line)
    n = len(words)
    raw = b"".join(words)
    chars = len(raw) if raw.isascii() else len(raw.decode())
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    kept = not failed and lost <= max_loss * n
    return Judged(n, chars, len(_SYMBOLS.findall(text)), with_words - len(seen), repeats, failed, lost, kept, text if not lost else "\n".join(left))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row for each row: id, the counts, base_failed, lost_words, kept."""
    long, flag = T.LongType(), T.BooleanType()
    kinds = [(c, long) for c in COUNTS] + [("base_failed", flag), ("lost_words", long), ("kept", flag)]
    own = id_name(id_col, [c for c, _ in kinds])
    schema = T.StructType([T.StructField(own, docs.schema[id_col].dataType), *(T.StructField(c, kind) for c, kind in kinds)])
    marked, marks, known = _with_boilerplate(docs, text_col, most_broadcast)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boilerplate = set(known.value.tolist())
        for batch in batches:
            for part in slices(batch):
                found = _judged(part, 1, 2, boilerplate, max_loss)
                columns = [pa.array([getattr(x, c) for x in found], pa.int64() if kind == long else pa.bool_()) for c, kind in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return marked.select(F.col(id_col).alias("_tw_id"), F.col(text_col).alias("_tw_text"), marks).mapInArrow(run, schema)


def clean(
    docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", max_loss: float = MAX_LOSS, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """The rows that are kept, all columns, without the failed lines of their texts.

    Where a text lost lines and the column ``length_col`` is there as a whole number, it
    gets the new number of characters.
    """
    at = docs.columns.index(text_col)
    schema = docs.schema
    counted = docs.columns.index(length_col) if length_col in docs.columns and isinstance(schema[length_col].dataType, (T.LongType, T.IntegerType)) else None
    marked, _, known = _with_boilerplate(docs, text_col, most_broadcast)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boilerplate = set(known.value.tolist())
        for batch in batches:
            for part in slices(batch, at):
                found = _judged(part, at, part.num_columns - 1, boilerplate, max_loss)
                columns = list(part.columns)[:-1]
                columns[at] = pa.array([x.text for x in found], columns[at].type)
                if counted is not None:
                    old = columns[counted]
                    columns[counted] = pa.array([len(x.text) if x.lost_words else n for x, n in zip(found, old.to_pylist())], old.type)
                rows = pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])
                yield rows.filter(pa.array([x.kept for x in found], pa.bool_()))

    return marked.mapInArrow(run, schema)
