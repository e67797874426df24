"""Encoding of whole texts by their different matches of a split pattern.

A byte-pair encoder works on each match of its split pattern separately, so a text's ids
follow from those of its matches, and natural text repeats most of them. The bytes of
many texts are cut into matches at one time, by array operations over a class for each
byte (letter, number, white space or other); equal matches are then found by Arrow's
dictionary encoding, only the different ones are encoded, and their ids are laid out
again in the order of the texts. No text is treated in another way than another, and
nothing is read in part.

Which characters are letters, numbers and white space is asked of the engine that the
ids must agree with, as engines know different versions of Unicode.

Memory is bounded by bytes: the arrays are a small multiple of the texts that are
encoded at one time (``common.SLICE_BYTES``, or one text), and the matches that a worker
remembers from one slice to the next have KEEP_BYTES at most; beyond that it starts
again.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = range(4)
CODES = 0x110000
#: From here on no code point is a letter, a number or white space.
LETTERS_END = 0x40000
#: What the remembered matches of a worker may take, with KEEP_EACH for the objects of each.
KEEP_BYTES, KEEP_EACH = 32 << 20, 150
#: Longer matches are encoded but not remembered.
KEEP_LENGTH = 64


def class_table(find: Callable[[str, str], Iterable[str]]) -> np.ndarray:
    """The class of every code point. find: the parts of a string that are of a character class."""
    table = np.zeros(CODES, dtype=np.uint8)
    for low in range(0, LETTERS_END, 1 << 15):
        chars = "".join(chr(c) for c in range(low, low + (1 << 15)) if not 0xD800 <= c < 0xE000)
        for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            found = "".join(find(name, chars))
            table[np.frombuffer(found.encode("utf-32-le"), dtype="<u4")] = kind
    return table


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lengths, code points) of the characters of UTF-8 bytes that are not ASCII."""
    places = np.flatnonzero(raw >= 0xC0)
    lead = raw[places].astype(np.int32)
    lengths = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    codes = lead & (0x7F >> lengths)
    for k in (1, 2, 3):
        more = lengths > k
        codes[more] = codes[more] << 6 | (raw[places[more] + k] & 0x3F)
    return places, lengths, codes


def byte_classes(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    ascii_classes = np.zeros(256, dtype=np.uint8)
    ascii_classes[:128] = table[:128]
    classes = ascii_classes[raw]
    places, lengths, codes = code_points(raw)
    own = table[codes]
    for k in range(4 if len(places) else 0):
        inside = lengths > k
        classes[places[inside] + k] = own[inside]
    return classes


def _edges(n: int, docs: np.ndarray) -> np.ndarray:
    """Whether a text begins at a byte, for each byte and the end."""
    edges = np.zeros(n + 1, dtype=bool)
    edges[docs] = True
    return edges


def _contractions(raw: np.ndarray, edges: np.ndarray, starts: np.ndarray) -> None:
    """Joins an apostrophe at which a match begins with s, t, m, d, re, ve or ll after it, in place."""
    n = len(raw)
    at = np.flatnonzero((raw == 0x27) & starts)
    at = at[at + 1 < n]
    at = at[~edges[at + 1]]
    first = raw[at + 1]
    third = np.minimum(at + 2, n - 1)
    second = np.where((at + 2 < n) & ~edges[third], raw[third], 0)
    one = np.isin(first, np.frombuffer(b"stmd", dtype=np.uint8))
    two = np.zeros(len(at), dtype=bool)
    for pair in (b"re", b"ve", b"ll"):
        two |= (first == pair[0]) & (second == pair[1])
    for chosen, length in ((at[one], 2), (at[two], 3)):
        starts[chosen + 1] = False
        after = chosen + length
        starts[after[after < n]] = True


def spaced_starts(raw: np.ndarray, classes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the matches begin by the pattern

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``

    raw: the bytes of all texts; docs: where each text begins, then the end. Every byte
    belongs to one match. Of white space before something else the last character is
    apart, and goes with what follows if it is a blank.
    """
    edges = _edges(len(raw), docs)
    starts = edges[:-1].copy()
    starts[1:] |= classes[1:] != classes[:-1]
    last = np.flatnonzero((classes[:-1] == SPACE) & (classes[1:] != SPACE) & ~edges[1:-1])
    blank = last[raw[last] == 0x20]
    while len(inner := np.flatnonzero((raw[last] & 0xC0) == 0x80)):
        last[inner] -= 1
    starts[last] = True
    starts[blank + 1] = False
    _contractions(raw, edges, starts)
    return np.flatnonzero(starts)


def word_starts(raw: np.ndarray, classes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the matches begin by the pattern

    ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``

    White space, which is in no match, stands at the head of the match that follows, or
    alone at the end of a text.
    """
    edges = _edges(len(raw), docs)
    starts = edges[:-1].copy()
    starts[1:] |= classes[1:] != classes[:-1]
    starts |= (classes == NUMBER) & ((raw & 0xC0) != 0x80)
    _contractions(raw, edges, starts)
    starts[1:] &= (classes[:-1] != SPACE) | edges[1:-1]
    return np.flatnonzero(starts)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the bytes of all texts, null counting as empty, and 0 with the end of each."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())]).fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, dtype=np.uint8)
    return raw, ends - ends[0]


class MatchEncoder:
    """Ids of whole texts by way of their matches.

    prepare: (bytes, ends) of texts as the pattern gets them. table: classes of code points.
    find_starts: where matches begin. encode: ids of each of some matches, as little-endian
    32-bit bytes.
    """

    def __init__(
        self,
        table: np.ndarray,
        find_starts: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
        encode: Callable[[list[bytes]], list[bytes]],
        prepare: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] = bytes_of,
    ):
        self.table, self.find_starts, self.encode, self.prepare = table, find_starts, encode, prepare
        self.kept: dict[bytes, bytes] = {}
        self.kept_bytes = 0

    def forget(self) -> None:
        self.kept, self.kept_bytes = {}, 0

    def _known(self, matches: list[bytes]) -> list[bytes]:
        if self.kept_bytes > KEEP_BYTES:
            self.forget()
        found = [*map(self.kept.get, matches)]
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.encode([matches[i] for i in new])):
            match = matches[i]
            found[i] = ids
            if len(match) <= KEEP_LENGTH and self.kept_bytes <= KEEP_BYTES:
                self.kept[match] = ids
                self.kept_bytes += KEEP_EACH + len(match) + len(ids)
        return found

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts as int32, and 0 with the end of each text's ids."""
        raw, docs = self.prepare(texts)
        if not len(raw):
            return np.empty(0, dtype=np.int32), np.zeros(len(docs), dtype=np.int64)
        starts = self.find_starts(raw, byte_classes(raw, self.table), docs)
        offsets = np.append(starts, len(raw))
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = whole.dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        ends = np.cumsum([0, *map(len, ids)]) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).take(coded.indices)
        token_ends = lists.offsets.to_numpy()
        return lists.flatten().to_numpy(), token_ends[np.searchsorted(starts, docs)] - token_ends[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes; None counts as empty."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in zip(ends, ends[1:])]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) with ``end_id`` after each text."""
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@functools.cache
def library_classes() -> np.ndarray:
    """The classes of the tokenizers library's pattern engine."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    @functools.cache
    def splitter(name: str) -> Split:
        return Split(Regex(name + "+"), "removed", invert=True)

    return class_table(lambda name, chars: (part for part, _ in splitter(name).pre_tokenize_str(chars)))


def lower_table() -> np.ndarray:
    """The lower case of each code point whose text form is settled by itself, else 0.

    Left at 0: what canonical composition may change or join to its neighbours, what has no
    lower case of the same length in UTF-8, and what Unicode 3.2 did not know yet.
    """
    old = unicodedata.ucd_3_2_0
    table = np.zeros(CODES, dtype=np.int32)
    for code in range(0x80, 0x30000):
        char = chr(code)
        if old.category(char) in ("Cn", "Cs", "Co") or 0x1100 <= code < 0x1200:
            continue
        low = char.lower()
        alone = not unicodedata.combining(char) and unicodedata.category(char)[0] != "M" and unicodedata.is_normalized("NFC", char)
        if alone and len(low) == 1 and len(low.encode()) == len(char.encode()):
            table[code] = ord(low)
    return table


def lowered(normalize: Callable[[str], str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """``prepare`` of texts that are composed (NFC) and in lower case.

    Texts with a character that ``lower_table`` leaves open go through ``normalize``.
    """
    table, ascii_lower = lower_table(), np.arange(256, dtype=np.uint8)
    ascii_lower[65:91] += 32

    def prepare(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        given, ends = bytes_of(texts)
        raw = ascii_lower[given]
        places, lengths, codes = code_points(raw)
        low = table[codes]
        changed = np.flatnonzero((low != 0) & (low != codes))
        for length in (2, 3, 4):
            at = changed[lengths[changed] == length]
            for k in range(length):
                part = low[at] >> 6 * (length - 1 - k)
                raw[places[at] + k] = (0x80 | part & 0x3F) if k else (0x100 - (0x100 >> length) | part)
        odd = np.unique(np.searchsorted(ends, places[low == 0], "right") - 1)
        if not len(odd):
            return raw, ends
        lengths_now, parts, at = np.diff(ends), [], 0
        for i in odd.tolist():
            own = normalize(given[ends[i] : ends[i + 1]].tobytes().decode()).encode()
            parts += [raw[at : ends[i]].tobytes(), own]
            lengths_now[i], at = len(own), int(ends[i + 1])
        parts.append(raw[at:].tobytes())
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths_now)])

    return prepare


@functools.cache
def library_encoder(path: str) -> MatchEncoder:
    """A MatchEncoder over the tokenizers library and the vocabulary file at ``path``.

    One for each Python worker and file, as loading takes a while. Each match goes to the
    library's model. Strings of special tokens that stand in a text are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenize, letters, classes = tokenizer.model.tokenize, byte_letters(), library_classes()

    def encode(matches: list[bytes]) -> list[bytes]:
        return [as_bytes([t.id for t in tokenize(m.decode("latin-1").translate(letters))]) for m in matches]

    if tokenizer.normalizer is None:
        return MatchEncoder(classes, spaced_starts, encode)
    spaces = "".join(map(chr, np.flatnonzero(classes == SPACE)))

    def encode_words(matches: list[bytes]) -> list[bytes]:
        words = [m.decode().lstrip(spaces).encode() for m in matches]
        known = iter(encode([w for w in words if w]))
        return [next(known) if w else b"" for w in words]

    return MatchEncoder(classes, word_starts, encode_words, lowered(tokenizer.normalizer.normalize_str))
