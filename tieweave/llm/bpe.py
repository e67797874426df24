"""Byte-level byte-pair encoding and decoding over a rank file.

``merge`` keeps a segment tree over the byte positions of one word. A leaf holds the
rank of the pair that begins at its position and every inner node the least rank below
it, so the leftmost pair of least rank is found from the root, and a merge is a few
point updates on live neighbours, each logarithmic in the word's length. A word of one
megabyte without blanks therefore stays practical.

``merge_many`` has such a tree for each of many words, in one array, and does the next merge
of all of them at one time; words of more than LONGEST bytes are merged one by one.

Equal matches of the split pattern are merged once in a slice of texts (see ``matches``).

Defined results: null and empty texts have no ids and decode to no bytes; decoding gives
back the UTF-8 bytes of the text, whatever characters it has and however long it is;
repeated rows are coded each on their own; a null id stays null; an empty table gives no
rows; other columns are not read, and an id column called ``ids`` or ``decoded`` comes
back with ``_id`` after its name.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, tokenizer_path
from .matches import MatchEncoder, as_bytes, class_table, spaced_starts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Above every rank.
NO_PAIR = 1 << 60
NO_RANK = 1 << 30
#: Words that are merged side by side have so many bytes each at most, and fill so many leaves.
LONGEST, SIDE_BY_SIDE = 64, 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from lines of a base64 token and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the split pattern."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    size = 1 << max(0, n - 1).bit_length()
    following = list(range(1, n + 2))  # the position after the token that begins here; n ends the word
    before = list(range(-1, n))
    rank_of = ranks.get
    tree = [NO_PAIR] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = rank_of(word[i : i + 2], NO_PAIR)
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(at: int, rank: int) -> None:
        node = size + at
        tree[node] = rank
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] != NO_PAIR:
        least, node = tree[1], 1
        while node < size:
            node *= 2
            if tree[node] != least:
                node += 1
        at = node - size
        gone = following[at]
        end = following[gone]
        following[at] = end
        put(gone, NO_PAIR)
        if end < n:
            before[end] = at
            put(at, rank_of(word[at : following[end]], NO_PAIR))
        else:
            put(at, NO_PAIR)
        if at:
            previous = before[at]
            put(previous, rank_of(word[previous:end], NO_PAIR))
    ids, at = [], 0
    while at < n:
        end = following[at]
        ids.append(ranks[word[at:end]])
        at = end
    return ids


@functools.cache
def classes() -> np.ndarray:
    """The classes of code points in the pattern engine of the tiktoken library."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}

    @functools.cache
    def finder(name: str) -> tiktoken.Encoding:
        return tiktoken.Encoding(name, pat_str=name + "+", mergeable_ranks=ranks, special_tokens={})

    return class_table(lambda name, chars: [bytes(finder(name).encode_ordinary(chars)).decode()])


class PairTable:
    """The ids of what two tokens make together, for arrays of pairs: a hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()) + 1
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ids.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        left, own = np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int32)
        slots = self._slots(left)
        while len(left):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = left[free]
            here = self.keys[slots] == left
            self.ids[slots[here]] = own[here]
            left, own, slots = left[~here], own[~here], (slots[~here] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair, or NO_RANK."""
        keys = left.astype(np.int64) * self.width + right
        slots = self._slots(keys)
        seen = self.keys[slots]
        out = self.ids[slots]
        missed = np.flatnonzero((seen != keys) & (seen >= 0))
        out[(seen != keys)] = NO_RANK
        while len(missed):
            slots[missed] = at = (slots[missed] + 1) & (len(self.keys) - 1)
            seen = self.keys[at]
            hit = seen == keys[missed]
            out[missed[hit]] = self.ids[at[hit]]
            missed = missed[~hit & (seen >= 0)]
        return out


def merge_many(words: list[bytes], pairs: PairTable, single: np.ndarray) -> list[bytes]:
    """The ids of each word as little-endian 32-bit bytes; single: the id of each byte.

    No word is empty or longer than LONGEST.
    """
    out: list[bytes] = [b""] * len(words)
    sizes = np.array([(len(w) - 1).bit_length() for w in words])
    for bits in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == bits)
        for at in range(0, len(places), SIDE_BY_SIDE >> bits):
            own = places[at : at + (SIDE_BY_SIDE >> bits)].tolist()
            ids, counts = _merge_alike([words[i] for i in own], max(1, bits), pairs, single)
            raw, ends = ids.astype("<i4").tobytes(), [0, *np.cumsum(4 * counts).tolist()]
            for k, i in enumerate(own):
                out[i] = raw[ends[k] : ends[k + 1]]
    return out


def _merge_alike(words: list[bytes], bits: int, pairs: PairTable, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of each): words of at most 1 << bits bytes, a tree of that many leaves for each."""
    n, size = len(words), 1 << bits
    lengths = np.array([*map(len, words)])
    tokens = single[np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), dtype=np.uint8)].reshape(n, size)
    alive = np.arange(size) < lengths[:, None]
    tree = np.full((n, 2 * size), NO_RANK, dtype=np.int32)
    tree[:, size:-1] = np.where(alive[:, 1:], pairs.find(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, size - 1), NO_RANK)
    for level in range(bits - 1, -1, -1):
        tree[:, 1 << level : 2 << level] = tree[:, 2 << level : 4 << level].reshape(n, 1 << level, 2).min(axis=2)
    following = np.tile(np.arange(1, size + 1), (n, 1)).ravel()  # where the token after the one that begins here begins
    before = np.tile(np.arange(-1, size - 1), (n, 1)).ravel()
    tokens, tree, live = tokens.ravel(), tree.ravel(), alive.ravel()
    word = np.arange(n)
    while True:
        least = tree[2 * size * word + 1]
        word = word[least < NO_RANK]
        if not len(word):
            return tokens[live], live.reshape(n, size).sum(axis=1)
        least, root, first = least[least < NO_RANK], 2 * size * word, size * word
        node = np.ones(len(word), dtype=np.int64)
        for _ in range(bits):
            node *= 2
            node += tree[root + node] != least
        at = node - size
        gone = following[first + at]
        end = following[first + gone]
        tokens[first + at] = least
        following[first + at] = end
        live[first + gone] = False
        inside = np.flatnonzero(end < lengths[word])
        before[first[inside] + end[inside]] = at[inside]
        behind = np.flatnonzero(at > 0)
        previous = np.where(at > 0, before[first + at], at)
        tree[root + size + gone] = NO_RANK
        tree[root + node] = NO_RANK
        tree[(root + node)[inside]] = pairs.find(least[inside], tokens[first[inside] + end[inside]])
        tree[(root + size + previous)[behind]] = pairs.find(tokens[(first + previous)[behind]], least[behind])
        changed = np.concatenate([size + gone, node, size + previous])
        roots = np.concatenate([root, root, root])
        for _ in range(bits):
            changed >>= 1
            children = roots + 2 * changed
            tree[roots + changed] = np.minimum(tree[children], tree[children + 1])


class BytePairCodec:
    """Encodes and decodes whole texts by the ranks at ``path``, each match of the split pattern by itself."""

    def __init__(self, path: str):
        self.ranks = ranks = load_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.encoder = MatchEncoder(classes(), spaced_starts, self.encode_words)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit bytes."""
        out = [None if (rank := self.ranks.get(w)) is None else as_bytes([rank]) for w in words]
        short = [i for i, ids in enumerate(out) if ids is None and len(words[i]) <= LONGEST]
        for i, ids in zip(short, merge_many([words[i] for i in short], self.pairs, self.single)):
            out[i] = ids
        return [as_bytes(merge(w, self.ranks)) if ids is None else ids for w, ids in zip(words, out)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@functools.cache
def codec(path: str) -> BytePairCodec:
    """One codec for each Python worker, as loading takes a while."""
    return BytePairCodec(path)


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """One row for each document: id, ids, decoded.

    ids holds the token ids as little-endian unsigned 32-bit bytes, decoded the bytes
    that those ids stand for. The split pattern is that of ``matches.spaced_starts``.
    """
    ranks = ranks or tokenizer_path(VOCABULARY)

    def make():
        coder = codec(ranks)

        def work(texts: pa.Array) -> list[pa.Array]:
            flat, ends = coder.encoder.encode_array(texts)
            ids = [flat[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            return [pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())]

        work.forget = coder.encoder.forget
        return work

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return map_text(docs, make, fields, id_col=id_col, text_col=text_col)
