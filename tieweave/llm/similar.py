"""Near copies by the exact similarity of word shingles, found through MinHash bands.

The shingles of a text are its runs of ``shingle_words`` words (a shorter text is one
shingle), by XXH64. Two texts link if the sets of their shingles have a Jaccard
similarity of SIMILAR (4/5) or more; what links, also by way of others, is a component.

1. Rows with equal sets are one node. A node has BANDS keys, each the hash of ROWS
   MinHash values; nodes under one key meet. A pair with similarity s meets with
   probability 1 - (1 - s ** ROWS) ** BANDS: 0.9994 at 0.8, above 0.99999 from 0.88 on.
2. Under each key all members are compared with the least of them, by their whole sets.
3. Keys of three members or more that are not in one component then are compared in
   full, so nothing that meets and is similar is lost. A key with more than BLOCK
   members is dealt out as pairs of blocks of members over several tasks.

Pairs that meet in another way (``meet``) are verified with those of step 2. No pair
links by MinHash alone. Of the pairs found in step 3 only a spanning forest is
emitted, so rows grow with the members of a group of near copies.

Defined results: null, empty and blank texts are equal to one another and similar to
nothing else; a very long text is compared whole; rows with a null id are left out;
repeated rows share a node, rows with one id and different texts have nodes of their
own; an empty table gives no rows; other columns are not read, and an id column that has
the name of the result comes back with ``_id`` after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import checkpointed, id_name, map_text, scratch_path

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
SEED = 42
BANDS, ROWS = 14, 4
#: Members of a key that one task compares with one another.
BLOCK = 128
#: Keys above this share of all members (one in so many) are joined by broadcast.
HOT_KEYS = 10_000
#: Shingles that are compared at one time.
COLUMNS = 4096


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different shingles of a text, hashed and sorted."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    first = (ends - lengths)[: len(last)]
    return np.unique(np.array([xxh64_intdigest(whole[i:j], SEED) for i, j in zip(first.tolist(), last.tolist())], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """A number of 64 bits: each is 1 if it is set in over half of the ``hashes``."""
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes)).view("<u8")[0])


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the MinHash permutations; always the same."""
    random = np.random.default_rng(20_240_229)
    masks, factors = random.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    return masks, factors | np.uint64(1)


def band_keys(own: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> list[int] | None:
    """A signed key for each band of a sorted set, or None for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(own):
        return None
    least = np.full(len(masks), np.iinfo(np.uint64).max)
    for at in range(0, len(own), COLUMNS):
        np.minimum(least, ((own[at : at + COLUMNS, None] ^ masks) * factors).min(axis=0), out=least)
    keys = [xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, *, with_sets: bool = False, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, node, fingerprint, bands) for each row, or (id, node, set). The fingerprint is the majority of the set."""
    longs = T.ArrayType(T.LongType())

    def make():
        from xxhash import xxh64_intdigest

        masks, factors = permutations()

        def work(given: pa.Array) -> list[pa.Array]:
            texts = given.to_pylist()
            nodes, prints, others = [], [], []
            for text in texts:
                own = shingles(text, shingle_words)
                nodes.append(xxh64_intdigest(own.tobytes(), SEED))
                others.append(own.view(np.int64) if with_sets else band_keys(own, masks, factors))
                if not with_sets:
                    prints.append(majority(own))
            numbers = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in ([nodes] if with_sets else [nodes, prints])]
            return [*numbers, pa.array(others, pa.list_(pa.int64()))]

        return work

    numbers = [T.StructField(c, T.LongType()) for c in (["node"] if with_sets else ["node", "fingerprint"])]
    fields = [*numbers, T.StructField("set" if with_sets else "bands", longs)]
    return map_text(docs, make, fields, id_col=id_col, text_col=text_col)


def linked(sets: list[np.ndarray], roots: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets that join all that is similar; equal ``roots`` are joined already."""
    label = np.unique(roots, return_inverse=True)[1]
    if label.max(initial=0) == 0:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    at = shared[column]
    owner, column = owner[at], (np.cumsum(shared) - 1)[column[at]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for begin in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, (begin, begin + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[low:high], column[low:high] - begin] = 1
        common += (has @ has.T).astype(np.int64)
    p, q = SIMILAR
    alike = (p + q) * common >= p * (sizes[:, None] + sizes)
    edges = []
    for i, j in np.argwhere(np.triu(alike & (label[:, None] != label), 1)).tolist():
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            edges.append((i, j))
    return edges


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) that are similar by their whole sets."""
    p, q = SIMILAR
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where((p + q) * common >= p * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _compared(members: DataFrame, block: int) -> DataFrame:
    """(a, b): similar nodes of different roots under a key, enough of them to join each component.

    ``members`` has key, n (its members), node, root and set.
    """
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (
        members.withColumn("blocks", blocks)
        .select("key", "node", "root", "set", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "root", "set")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, roots, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            places = np.array(linked(sets, np.array(roots, dtype=np.int64)), dtype=np.int64).reshape(-1, 2)
            ends = np.array(nodes, dtype=np.int64)[places]
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            column = batch.column(3)
            for i, (c, node, root) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if c != cell:
                    if len(nodes) > 1:
                        yield found()
                    cell, nodes, roots, sets = c, [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(np.array(column[i].values))
        if len(nodes) > 1:
            yield found()

    return dealt.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, schema)


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, block: int = BLOCK, meet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component_id) for each row with an id; component_id is the least id reachable.

    ``meet`` gives further pairs (a, b) of nodes to verify, from (node, fingerprint).
    """
    spark, names = docs.sparkSession, {"id_col": "id", "text_col": "text", "shingle_words": shingle_words}
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    path = scratch_path(spark, "signatures")
    signatures(docs, **names).write.parquet(path)
    prints = spark.read.parquet(path)
    members = checkpointed(prints.select("node", F.explode("bands").alias("key")).distinct())
    shared = checkpointed(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1"))
    # At most HOT_KEYS keys can have more than one in HOT_KEYS of all members.
    hot = F.col("n") > members.count() // HOT_KEYS
    large, small = F.broadcast(shared.where(hot)), shared.where(~hot)
    meeting = checkpointed(members.join(large, "key").unionByName(members.join(large.select("key"), "key", "left_anti").join(small, "key")))
    stars = meeting.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    if meet is not None:
        stars = stars.unionByName(meet(prints.select("node", "fingerprint").distinct()))
    stars = checkpointed(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = checkpointed(meeting.select("node").unionByName(stars.select(F.explode(F.array("a", "b")).alias("node"))).distinct())

    ids = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    read = signatures(docs.join(checkpointed(ids.select("id").distinct()), "id", "left_semi"), with_sets=True, **names)
    path = scratch_path(spark, "sets")
    read.select("node", "set").join(wanted, "node", "left_semi").dropDuplicates(["node"]).write.parquet(path)
    sets = spark.read.parquet(path)

    links = checkpointed(_verified(stars, sets))
    roots = connected_components(links)
    labelled = meeting.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    rest = checkpointed(labelled.join(apart, "key", "left_semi").select("key", "n", "node", "root"))
    if not rest.isEmpty():
        more = checkpointed(_compared(rest.join(sets, "node"), block))
        roots = connected_components(links.unionByName(more))

    nodes = prints.groupBy("node").agg(F.min("id").alias("least"))
    joined = checkpointed(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    known = checkpointed(joined.join(least, "root").select("node", "component_id"))
    return prints.join(known, "node").select(F.col("id").alias(id_name(id_col, ["component_id"])), "component_id")
