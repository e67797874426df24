"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words, with A-Z in lower case. A line goes if an
earlier line (by document id, then line number) is the same, or is within the edit bound
of it: the insertion, deletion or replacement of one word in NEAR_WORDS, and of one at
most. A line of fewer than NEAR_WORDS words thus goes only if an earlier one has the same
words. A line without a word always stays.

1. Every line gets a 128-bit hash; different lines get their first place. Lines of NEAR_WORDS words or
   more go through steps 2 to 5 as well.
2. One edit leaves one half of a line alone. Lines that share a half with a different
   line are candidates; halves are hashed at the two lengths at which two lines that one
   edit parts must agree. All others are done.
3. The candidates' words are fetched by a second read of the documents, through a Bloom
   filter of the shared halves (a chance hit is one candidate more, nothing else).
4. A candidate of n words has hashed keys: itself, and for each word the rest without it,
   alone and with the word's place. Equal (place, rest) keys are replacements; an own key
   equal to a rest is an insertion or deletion. A line's hash is a sum over its words and
   places, so the keys of all rests come from prefix sums. Placed keys are counted first,
   and only those that two lines have are emitted with their lines; rests only if they may
   be a whole candidate (both by such filters).
5. Under each key the earliest line is found by aggregation, every other line is joined to
   it, the edit distance is verified on the words, and the later line goes.

Filters have at most MAX_FILTER_BYTES; beyond what that serves well, more candidates and
keys pass, and the exact steps behind them do more work with the same result.

A key's group is reduced to its earliest line before the join, so rows grow with the
variants, never with pairs, and a hot line is one row for each task from step 1 on.

Defined results: null and empty texts have no lines that could go; rows with the same id
and text are copies of one document, so equal lines at the same number are the same line
and stay; rows with the same id (or none) and different texts are documents of their own,
in the order of a hash of their texts; a null id comes last; very long texts and lines
are compared whole; an empty table gives no rows; other columns, whatever their names, are
not read by ``dropped_lines`` and pass through ``without_lines``. An id column that has
the name of a result comes back with ``_id`` after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, id_name, named, scratch_path, slices
from .exact import BITMAP_SLOTS, filter_slots

#: One word in so many may be edited, and one at most.
NEAR_WORDS = 8
MAX_FILTER_BYTES = 32 << 20
#: Candidate lines that a task remembers so as not to send them again.
REMEMBERED = 100_000


def line_words(line: str) -> list[bytes]:
    return line.encode().lower().split()


def half_digests(words: list[bytes]) -> bytes:
    """Hashes (8 bytes each) of halves of which lines that one edit parts share one at least."""
    from xxhash import xxh3_64_digest

    n, out = len(words), b""
    for h in {(n - 1) // 2, (n - 2) // 2}:
        out += xxh3_64_digest(b" ".join(words[:h]), 1 << 32 | h) + xxh3_64_digest(b" ".join(words[n - h :]), 2 << 32 | h)
    return out


def as_longs(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype=">i8").astype(np.int64)


#: Kinds of variants.
WHOLE, REST, PLACED = 0, 1, 2
#: Odd, so it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed (the finish of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variant_keys(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, rest, placed, counts) of lines: a key for each line, and two for each word.

    A line's number is the sum of word hash times BASE to the power of the word's place.
    Without word i, the words behind it stand one place before: their sum is divided by BASE.
    """
    from xxhash import xxh3_64_digest

    counts = np.array([len(x) for x in lines], dtype=np.int64)
    if not len(counts) or not counts.sum():
        none = np.empty(0, dtype=np.int64)
        return np.zeros(len(counts), dtype=np.int64), none, none, counts
    own = as_longs(b"".join([xxh3_64_digest(w) for x in lines for w in x])).view(np.uint64)
    starts = np.cumsum(counts) - counts
    place = np.arange(len(own)) - np.repeat(starts, counts)
    powers = np.empty(int(counts.max()), dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(np.full(len(powers) - 1, BASE, dtype=np.uint64), out=powers[1:])
    terms = own * powers[place]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    total = sums[starts + counts] - sums[starts]
    before = sums[:-1] - np.repeat(sums[starts], counts)
    behind = np.repeat(total, counts) - before - terms
    rest = mixed(before + behind * np.uint64(INVERSE))
    placed = mixed(rest + place.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    return mixed(total).view(np.int64), rest.view(np.int64), placed.view(np.int64), counts


def within_one(a: list, b: list) -> bool:
    """Whether one insertion, deletion or replacement at most turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    front = 0
    while front < short and a[front] == b[front]:
        front += 1
    back = 0
    while back < short - front and a[-1 - back] == b[-1 - back]:
        back += 1
    return max(len(a), len(b)) - front - back <= 1


LONG = T.LongType()


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, h1, h2, halves) of all lines with a word."""
    fields = [T.StructField("doc", docs.schema[id_col].dataType), *(T.StructField(c, LONG) for c in ("line", "h1", "h2")), T.StructField("halves", T.ArrayType(LONG))]
    schema = T.StructType(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch):
                rows, numbers, hashes, halves, n_halves = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    for number, line in enumerate((text or "").split("\n")):
                        words = line_words(line)
                        if not words:
                            continue
                        own = half_digests(words) if len(words) >= NEAR_WORDS else b""
                        rows.append(row)
                        numbers.append(number)
                        hashes.append(xxh3_128_digest(b" ".join(words)))
                        halves.append(own)
                        n_halves.append(len(own) // 8)
                owners = part.column(0).take(pa.array(rows, pa.int64()))
                pairs = as_longs(b"".join(hashes)).reshape(-1, 2)
                ends = pa.array(np.concatenate([[0], np.cumsum(n_halves)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(as_longs(b"".join(halves))))
                yield pa.RecordBatch.from_arrays([owners, pa.array(numbers, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), lists], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _filter(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of 64-bit keys as bits, of at most MAX_FILTER_BYTES."""
    slots = filter_slots(keys.count(), max_bytes=MAX_FILTER_BYTES)
    places = F.array(F.pmod(F.col(column), F.lit(slots)) + 1, F.pmod(F.shiftright(column, 32), F.lit(slots)) + 1)
    slot = keys.select(F.explode(places).alias("slot"))
    bitmaps = slot.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    bits = np.zeros(slots // 8, dtype=np.uint8)
    for bucket, own in bitmaps.toLocalIterator():
        # Spark counts bits and buckets from 1 on.
        at = (bucket - 1) * BITMAP_SLOTS // 8
        bits[at : at + len(own)] = np.frombuffer(own, dtype=np.uint8)
    return bits


def _hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in a filter."""
    slots = len(bits) * 8
    a, b = keys % slots, (keys >> 32) % slots
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _shared(keys: DataFrame, column: str) -> DataFrame:
    """The keys that two different lines have, from (key, h1)."""
    own = keys.groupBy(column).agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
    return own.where("a != b").select(column)


def _candidates(docs: DataFrame, halves: DataFrame, text_col: str) -> DataFrame:
    """(h1, h2, words) of the lines that share a half with another, words joined by blanks."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(halves, "half"))
    schema = T.StructType([T.StructField("h1", LONG), T.StructField("h2", LONG), T.StructField("words", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        own, sent = shared.value, set()
        for batch in batches:
            for part in slices(batch, 0):
                lines, digests, counts = [], [], []
                for text in part.column(0).to_pylist():
                    for line in (text or "").split("\n"):
                        words = line_words(line)
                        if len(words) >= NEAR_WORDS:
                            found = half_digests(words)
                            lines.append(words)
                            digests.append(found)
                            counts.append(len(found) // 8)
                if not lines:
                    continue
                hits = _hits(own, as_longs(b"".join(digests)))
                starts = np.cumsum(counts) - counts
                hashes, texts = [], []
                for i in np.flatnonzero(np.logical_or.reduceat(hits, starts)).tolist():
                    text = b" ".join(lines[i])
                    pair = xxh3_128_digest(text)
                    if pair not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(pair)
                        hashes.append(pair)
                        texts.append(text)
                pairs = as_longs(b"".join(hashes)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(texts, pa.binary())], names=schema.names)

    found = docs.select(text_col).mapInArrow(run, schema)
    return found.groupBy("h1", "h2").agg(F.first("words").alias("words"))


def _wholes(candidates: DataFrame) -> DataFrame:
    """(key) of each candidate itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                whole = variant_keys([x.split(b" ") for x in part.column(0).to_pylist()])[0]
                yield pa.RecordBatch.from_arrays([pa.array(whole)], names=["key"])

    return candidates.select("words").mapInArrow(run, "key long")


def _variants(candidates: DataFrame, whole_keys: np.ndarray | None = None, placed_keys: np.ndarray | None = None) -> DataFrame:
    """(kind, key, h1, h2) of the candidates' variants.

    Without filters the placed ones; with them whole lines, rests that may be a whole
    line, and placed ones that may be shared.
    """
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *(T.StructField(c, LONG) for c in ("key", "h1", "h2"))])
    shared = candidates.sparkSession.sparkContext.broadcast((whole_keys, placed_keys))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_filter, placed_filter = shared.value
        for batch in batches:
            for part in slices(batch, 2):
                whole, rest, placed, counts = variant_keys([x.split(b" ") for x in part.column(2).to_pylist()])
                line = np.repeat(np.arange(len(counts)), counts)
                if placed_filter is None:
                    keys, rows, kinds = placed, line, np.full(len(placed), PLACED)
                else:
                    r, p = np.flatnonzero(_hits(whole_filter, rest)), np.flatnonzero(_hits(placed_filter, placed))
                    keys, rows = np.concatenate([whole, rest[r], placed[p]]), np.concatenate([np.arange(len(whole)), line[r], line[p]])
                    kinds = np.repeat([WHOLE, REST, PLACED], [len(whole), len(r), len(p)])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(keys), part.column(0).take(at), part.column(1).take(at)], names=schema.names)

    return candidates.select("h1", "h2", "words").mapInArrow(run, schema)


def _verified(pairs: DataFrame) -> DataFrame:
    """The (h1, h2) of pairs whose words are within one edit."""
    schema = T.StructType([T.StructField("h1", LONG), T.StructField("h2", LONG)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            near = pa.array([within_one(a.split(b" "), b.split(b" ")) for a, b in both], pa.bool_())
            yield batch.select(["h1", "h2"]).filter(near)

    return pairs.select("h1", "h2", "words", "words_first").mapInArrow(run, schema)


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line) of every line that goes, ``doc`` being the id; lines are numbered from 0."""
    rows, name = named(docs, id_col, text_col)
    return _dropped(rows, name, text_col).select("doc.id", "line").withColumnRenamed("id", "doc")


def _dropped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line) of every line that goes, where ``id_col`` tells documents apart."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    _lines(docs, id_col, text_col).write.parquet(path)
    lines = spark.read.parquet(path)
    place = F.struct("doc", "line")
    path = scratch_path(spark, "different")
    lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("n")).write.parquet(path)
    different = spark.read.parquet(path)

    halves = checkpointed(_shared(lines.select("h1", F.explode("halves").alias("half")), "half"))
    words = checkpointed(_candidates(docs, halves, text_col))
    placed = checkpointed(_shared(_variants(words).select("key", "h1"), "key"))
    keyed = _variants(words, _filter(_wholes(words), "key"), _filter(placed, "key")).distinct()
    candidates = checkpointed(words.join(different.select("h1", "h2", "place"), ["h1", "h2"]))
    keyed = checkpointed(keyed.join(candidates.select("h1", "h2", "place"), ["h1", "h2"]))
    replaced = (F.col("kind") == PLACED).alias("replaced")
    line = F.struct("place", "h1", "h2")
    first = keyed.groupBy(replaced, "key").agg(
        F.min(F.when(F.col("kind") != REST, line)).alias("first_own"), F.min(F.when(F.col("kind") == REST, line)).alias("first_rest"), F.count("*").alias("n")
    )
    first = first.where("n > 1 and (replaced or first_rest is not null and first_own is not null)").drop("n")
    # A whole line meets the first line of which it is a rest; all others meet the first whole or placed one.
    earlier = F.when(F.col("kind") == WHOLE, F.col("first_rest")).otherwise(F.col("first_own"))
    met = keyed.select("kind", replaced, "key", "place", "h1", "h2").join(first, ["replaced", "key"]).withColumn("first", earlier)
    pairs = met.where("first.place < place").select("h1", "h2", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2")).distinct()
    texts = candidates.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("words").alias("words_first"))
    near = _verified(pairs.join(candidates.select("h1", "h2", "words"), ["h1", "h2"]).join(texts, ["f1", "f2"])).distinct()

    fate = different.select("h1", "h2", "n", "place").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    fate = checkpointed(fate.where("near or n > 1"))
    gone = lines.select("doc", "line", "h1", "h2").join(fate, ["h1", "h2"])
    return gone.where(F.col("near").isNotNull() | ~place.eqNullSafe(F.col("place"))).select("doc", "line").distinct()


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_lines (with a visible word) and dropped, the numbers of the lines that go."""
    rows, name = named(docs.select(id_col, text_col), id_col, text_col)
    lists = _dropped(rows, name, text_col).groupBy(F.col("doc").alias(name)).agg(F.sort_array(F.collect_list("line")).alias("dropped"))
    some = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    own = rows.select(name, F.col(id_col).alias(id_name(id_col, ["n_lines", "dropped"])), F.size(some).cast("long").alias("n_lines"))
    return own.join(lists, name, "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<bigint>"))).drop(name)


def without_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that go taken out of the texts; all columns and rows stay."""
    rows, name = named(docs, id_col, text_col)
    (gone,) = fresh(rows, "dropped")
    lists = _dropped(rows, name, text_col).groupBy(F.col("doc").alias(name)).agg(F.collect_set("line").alias(gone))
    left = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i.cast("long")))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return rows.join(lists, name, "left").withColumn(text_col, text).select(*docs.columns)
