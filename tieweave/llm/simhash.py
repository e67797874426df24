"""SimHash near-duplicates found through pivot distance tables.

A fingerprint has 64 bits: bit i is 1 if it is set in over half the XXH64 hashes (seed
42) of the text's word shingles. Two fingerprints link at ``max_bits`` (4) or fewer
differing bits; documents with the same fingerprint are one node.

The bits are cut into six blocks, and each block has REFERENCES reference fingerprints.
The pivot table of a fingerprint holds its Hamming distance to each of them. For two
fingerprints the largest coordinate difference within a block bounds the block's
differing bits from below, and four differing bits leave two blocks or more alone, whose
coordinates then agree exactly. So

1. fingerprints that agree in all coordinates of two blocks meet, under one of 15 keys;
2. pairs whose largest coordinate differences add up to more than ``max_bits`` over the
   blocks are discarded;
3. survivors are verified bit by bit.

No pair within ``max_bits`` is lost. Of the verified pairs in a group only a spanning
forest is emitted (pairs that are connected already are not looked at again), so rows
grow with the members, not the pairs, of a group of near copies. A key with more than
BLOCK members is dealt out as pairs of blocks of members over several tasks.

``drop_near_duplicates`` can also link by the similarity of shingle sets, which so few
bits can't decide: five-word texts at 0.8 differ in 9.7 of 64 bits on average, where
unlinked ones are only 32 apart, and keys that meet at so many bits meet everywhere. Then
what the pivot tables link are candidates, those of ``similar`` come beside them for the
pairs that the bits can't reach, and each is verified exactly by its whole sets.

Defined results: a null or empty text, or one of white space only, has fingerprint zero
and links like any other; a very long text is read whole; repeated rows share a node; a
null id never becomes a component_id unless its whole component has null ids; an empty
table gives no rows; other columns are not read, and an id column that has the name of a
result comes back with ``_id`` after it. ``drop_near_duplicates`` keeps of each component
the row with the least id (null last; of one id, the least hash of the text), whatever
other rows have the same id; rows equal in id and text stay or go together; all columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from . import similar
from .common import checkpointed, id_name, map_text, named, scratch_path

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
REFERENCES = 12
#: First bit and number of bits of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Members of a key that one task compares with one another.
BLOCK = 4096


def pivots() -> list[list[int]]:
    """The reference values of each block, within the block's bits; always the same."""
    random = np.random.default_rng(20_240_229)
    return [[int(x) << first for x in random.integers(0, 1 << bits, REFERENCES)] for first, bits in BLOCKS]


def block_mask(block: int) -> int:
    first, bits = BLOCKS[block]
    return ((1 << bits) - 1) << first


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    first = (ends - lengths)[: len(last)]
    hashes = [xxh64_intdigest(whole[i:j], SEED) for i, j in zip(first.tolist(), last.tolist())]
    return similar.majority(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fingerprint as a signed long) for each row."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([signed(fingerprint(t, shingle_words)) for t in texts.to_pylist()], pa.int64())]

        return work

    return map_text(docs, make, [T.StructField("fingerprint", T.LongType())], id_col=id_col, text_col=text_col)


def coordinates(fingerprint: Column, block: int) -> Column:
    """The distances to the block's references, four bits each, as one long."""
    own = fingerprint.bitwiseAND(F.lit(signed(block_mask(block))))
    parts = [
        F.shiftleft(F.bit_count(own.bitwiseXOR(F.lit(signed(p)))).cast("long"), 4 * i) for i, p in enumerate(pivots()[block])
    ]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Distances of unsigned fingerprints to the references: (n, blocks, REFERENCES)."""
    out = np.empty((len(prints), len(BLOCKS), REFERENCES), dtype=np.int8)
    for b, references in enumerate(pivots()):
        own = prints & np.uint64(block_mask(b))
        for r, p in enumerate(references):
            out[:, b, r] = np.bitwise_count(own ^ np.uint64(p))
    return out


def forest(groups: np.ndarray, prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Places (i, j) of linked fingerprints that join all that is linked in each group.

    ``groups`` is sorted. Members at distance 1, 2, ... within a group are compared all
    at once; those with one label already are left out.
    """
    n, edges = len(groups), []
    table, label = pivot_table(prints), np.arange(n)
    shift, at = 1, np.flatnonzero(groups[1:] == groups[:-1])
    while len(at):
        i = at[label[at] != label[at + shift]]
        for begin in range(0, len(i), 1 << 16):
            left = i[begin : begin + (1 << 16)]
            bound = np.abs(table[left] - table[left + shift]).max(axis=2).sum(axis=1)
            left = left[bound <= max_bits]
            left = left[np.bitwise_count(prints[left] ^ prints[left + shift]) <= max_bits]
            for x in left.tolist():
                low, high = sorted((_root(label, x), _root(label, x + shift)))
                if low != high:
                    label[high] = low
                    edges.append((x, x + shift))
            while not np.array_equal(shorter := label[label], label):
                label = shorter
        shift += 1
        at = at[at + shift < n]
        at = at[groups[at] == groups[at + shift]]
    return edges


def _root(label: np.ndarray, x: int) -> int:
    while label[x] != x:
        x = label[x]
    return int(x)


def links(nodes: DataFrame, *, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints of ``nodes`` that link, enough of them to join each component.

    ``nodes`` has distinct fingerprints in the column ``fingerprint``.
    """
    if max_bits > len(BLOCKS) - 2:
        raise ValueError(f"at most {len(BLOCKS) - 2} bits")
    cells = [f"_c{b}" for b in range(len(BLOCKS))]
    table = nodes.select("fingerprint", *(coordinates(F.col("fingerprint"), b).alias(c) for b, c in enumerate(cells)))
    keys = [F.xxhash64(F.lit(k), x, y) for k, (x, y) in enumerate(combinations(cells, 2))]
    members = table.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meeting = members.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    dealt = (
        meeting.select("key", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .where("own != other or own = 0")
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fingerprint")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cells, held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def found(cells: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            places = np.array(forest(cells, prints, max_bits), dtype=np.int64).reshape(-1, 2)
            ends = prints.view(np.int64)[places]
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            cells = np.concatenate([held_cells, batch.column(0).to_numpy()])
            prints = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(cells):
                continue
            open_from = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            if open_from:
                yield found(cells[:open_from], prints[:open_from])
            held_cells, held = cells[open_from:], prints[open_from:]
        if len(held):
            yield found(held_cells, held)

    return dealt.repartition("cell").sortWithinPartitions("cell", "fingerprint").mapInArrow(run, schema)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(id, fingerprint, component_id) for each row; component_id is the least id reachable."""
    # A written table, as a checkpoint would read and hash all texts twice.
    path = scratch_path(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fingerprints(rows, id_col="id", text_col="text", shingle_words=shingle_words).write.parquet(path)
    prints = docs.sparkSession.read.parquet(path)
    nodes = checkpointed(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = connected_components(links(nodes, max_bits=max_bits)).withColumnRenamed("node", "fingerprint")
    joined = nodes.join(roots, "fingerprint")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(least, "root").select("fingerprint", "component_id")
    known = checkpointed(
        nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    )
    own = id_name(id_col, ["fingerprint", "component_id"])
    return prints.join(known, "fingerprint").select(F.col("id").alias(own), "fingerprint", "component_id")


def meeting(prints: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): nodes to compare, as the pivot tables link their fingerprints. prints: (node, fingerprint).

    Nodes of one fingerprint meet the least of them, those of linked ones by their least.
    """
    least = checkpointed(prints.groupBy("fingerprint").agg(F.min("node").alias("least")))
    own = prints.join(least.hint("merge"), "fingerprint").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    side = lambda c: least.select(F.col("fingerprint").alias(f"print_{c}"), F.col("least").alias(c)).hint("merge")
    found = links(least, max_bits=max_bits).distinct().withColumnsRenamed({"a": "print_a", "b": "print_b"})
    return own.unionByName(found.join(side("a"), "print_a").join(side("b"), "print_b").select("a", "b"))


def drop_near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    by_similarity: bool = False,
) -> DataFrame:
    """The rows of ``docs``, one of each component.

    Components link at ``max_bits`` of the fingerprints, or with ``by_similarity`` at a
    similarity of ``similar.SIMILAR`` of the sets of shingles.
    """
    rows, name = named(docs, id_col, text_col)
    columns = {"id_col": name, "text_col": text_col, "shingle_words": shingle_words}
    found = similar.near_copies(rows, meet=lambda prints: meeting(prints, max_bits=max_bits), **columns) if by_similarity else near_duplicates(rows, max_bits=max_bits, **columns)
    lost = found.where(F.col(name) != F.col("component_id")).select(name).distinct()
    return rows.join(lost, name, "left_anti").select(*docs.columns)
