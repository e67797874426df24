"""Tokens: packing, token files and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from tieweave.llm import bpe, packing, token_files
from tieweave.llm import queries
from tieweave.llm.common import scratch_path
from tieweave.llm.matches import library_encoder

ODD = [
    "", " ", "\n", " a", "a ", "a  b", "a \n b", "\n\na", "a\n\n", " \u0301x y", "don't 's 'll 'S", "a\tb  \t c", "x" * 3000, " " * 2000 + "z",
    "a \u3000b\u3000 c\u3000\u3000d \u3000", "'re're 's'x x'llama ''s \n'd", "J\u030c e\u0301\u0323 가각 ᄀ", "Ⱥ Ⱦ ẞ ſ Ω",
    "\x1c a \x1c b", "Σας ΣΑΣ x", "ﬁ ½ ² x²", "<|endoftext|> a<|endoftext|>", "\r\n a\r\nb \r c", "\x85 a\x85 b", "İ a İb ıI ǅ", "日本 語。 x", "🙂 🙂🙂",
]


@pytest.fixture(scope="module")
def texts(spark, data):
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab  \n\n\t'sé \u0301.1 🙂Éªº\xa0\xad") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    rows = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    return ODD + mixed + rows[:60]


def library_of(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return lambda text: library.encode(text, add_special_tokens=False).ids


def tiktoken_of(name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def same(encoder, wanted, texts):
    for text, ids in zip(texts, encoder.encode_all(texts)):
        own = wanted(text)
        assert ids == struct.pack(f"<{len(own)}I", *own), text[:50]


VOCABULARIES = {
    "byte_bpe_50k.json": (library_of, library_encoder),
    "word_bpe_49k.json": (library_of, library_encoder),
    "byte_bpe_50k.tiktoken": (tiktoken_of, lambda path: bpe.codec(path).encoder),
}


@pytest.mark.parametrize("name", VOCABULARIES)
def test_ids_are_the_librarys(texts, name):
    library, own = VOCABULARIES[name]
    wanted, encoder = library(name), own(public_tokenizers.path(name))
    for _ in range(2):  # with nothing and with all remembered
        same(encoder, wanted, texts)
    same(encoder, wanted, ["", texts[-1], "x" * 100_000])
    encoder.forget()


@pytest.mark.parametrize("name", VOCABULARIES)
def test_every_character_is_as_in_the_library(name):
    library, own = VOCABULARIES[name]
    chars = [chr(c) for c in [*range(0x40000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c} 1{c}{c}\n{c}" for c in chars[i : i + 4000]) for i in range(0, len(chars), 4000)]
    same(own(public_tokenizers.path(name)), library(name), texts)


def test_remembered_matches_stay_bounded(monkeypatch):
    from tieweave.llm import matches

    monkeypatch.setattr(matches, "KEEP_BYTES", 5_000)
    name = "byte_bpe_50k.json"
    encoder = matches.library_encoder.__wrapped__(public_tokenizers.path(name))
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(20)]
    for text in texts:
        same(encoder, library_of(name), [text])
        assert encoder.kept_bytes <= 5_000 + 500


def test_decoding_gives_the_text_back(texts):
    own = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    for text, ids in zip(texts, own.encoder.encode_all(texts)):
        assert own.decode(ids) == text.encode()


def test_merge_takes_the_leftmost_of_the_least():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258}
    assert bpe.merge(b"aaaaa", ranks) == [256, 257]
    assert bpe.merge(b"baaa", ranks) == [98, 257]


def test_merging_side_by_side_is_merging_one_by_one():
    own, rng = bpe.codec(public_tokenizers.path(bpe.VOCABULARY)), random.Random(9)
    words = [bytes(rng.choice(alphabet) for _ in range(n)) for n in range(1, bpe.LONGEST + 1) for alphabet in (b"a", b"ab", b"aehinst ", bytes(range(256))) for _ in range(20)]
    assert bpe.merge_many(words, own.pairs, own.single) == [bpe.as_bytes(bpe.merge(w, own.ranks)) for w in words]
    few = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258}
    found = bpe.merge_many([b"aaaaa", b"baaa", b"a"], bpe.PairTable(few), np.arange(256, dtype=np.int32))
    assert found == [bpe.as_bytes(x) for x in ([256, 257], [98, 257], [97])]


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_001])
def test_pieces_are_powers_of_two(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n
    assert all(x & (x - 1) == 0 for x in lengths)
    assert lengths == sorted(lengths, reverse=True)
    rest = [x for x in lengths if x < 2048]
    assert len(set(rest)) == len(rest)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Hello world. " * 900, "x"), (2, None, "y"), (2, "", "z"), (None, "a b", "w"), (7, "same", "v"), (7, "same", "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def test_pieces_cover_each_document_once(docs):
    rows = packing.pack_powers_of_two(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    own = sorted((r.start, r.length, r.ids) for r in rows if r.doc_id == 1)
    whole = b"".join(x[2] for x in own)
    wanted = [*library_of(packing.VOCABULARY)("Hello world. " * 900), 1]
    assert whole == struct.pack(f"<{len(wanted)}I", *wanted)
    assert [x[0] for x in own] == [sum(y[1] for y in own[:i]) for i in range(len(own))]
    assert sum(r.doc_id == 2 for r in rows) == 2
    assert packing.pack_powers_of_two(docs.limit(0)).count() == 0


def test_buckets_hold_one_length_each(spark, docs):
    path = scratch_path(spark, "buckets")
    packed = packing.pack_powers_of_two(docs, path=path)
    assert spark.read.parquet(path).where("bucket != length").isEmpty()
    two = packing.read_buckets(spark, path, packed.schema, [1, 4])
    assert {r.length for r in two.collect()} == {1, 4}
    assert "PartitionFilters: [bucket" in two._jdf.queryExecution().simpleString()


def test_very_long_texts_give_all_their_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 10_000)
    long = spark.createDataFrame([(1, "ab cd " * 100_000), (2, "x" * 50_000)], "doc_id long, text string")
    for r in long.collect():
        wanted = [*library_of(packing.VOCABULARY)(r.text), 1]
        rows = sorted(packing.cut_powers_of_two(long).where(f"doc_id = {r.doc_id}").collect(), key=lambda x: x.start)
        assert b"".join(x.ids for x in rows) == struct.pack(f"<{len(wanted)}I", *wanted)
        assert {x.doc_tokens for x in rows} == {len(wanted)}


@pytest.mark.parametrize("name", ["start", "length", "IDS", "sequence_id", "n_tokens", "part", "decoded", "_tw_tie"])
def test_id_columns_may_have_any_name(spark, docs, name):
    renamed = docs.withColumnRenamed("length", "extra").withColumnRenamed("doc_id", name)
    library = library_of(packing.VOCABULARY)
    n_tokens = sum(len(library(r.text or "")) + 1 for r in renamed.collect())
    assert sum(r.length for r in packing.pack_powers_of_two(renamed, id_col=name).collect()) == n_tokens
    assert bpe.encode_decode(renamed, id_col=name).count() == 6
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(renamed, path, id_col=name, partitions=2)
    assert token_files.read_token_files(spark, path).count() == 6


def test_token_files_lie_in_order(spark, docs):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs, path, partitions=3)
    back = token_files.read_token_files(spark, path)
    rows = sorted(back.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 7, 7]
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids[-1]) == (at, len(r.ids), 1)
        at += r.n_tokens
    sums = {(r.start, r.ids_crc32) for r in token_files.with_crc32(back, keep=["start"]).collect()}
    assert sums == {(r.start, zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))) for r in rows}


def parquet_of(path):
    import glob

    import pyarrow.parquet as pq

    return [f for f in map(pq.ParquetFile, sorted(glob.glob(f"{path.removeprefix('file:')}/*.parquet"))) if f.metadata.num_rows]


@pytest.fixture(scope="module")
def numbered(spark):
    """Token files of 20,000 documents with 3 to 12 words in one file."""
    path = scratch_path(spark, "numbered")
    docs = spark.range(20_000).selectExpr("id * 3 as doc_id", "repeat(concat('word', id % 97, ' '), cast(3 + id % 10 as int)) as text")
    token_files.write_token_files(docs, path, partitions=1)
    return path


def test_token_files_have_dictionary_and_delta_pages_and_indexes(numbered):
    (file,) = parquet_of(numbered)
    names = [file.metadata.row_group(0).column(i).path_in_schema.split(".")[0] for i in range(5)]
    columns = {name: file.metadata.row_group(0).column(i) for i, name in enumerate(names)}
    assert "RLE_DICTIONARY" in columns["ids"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def scanned_rows(df):
    """Rows that the scans of ``df`` hand on, after it has run."""
    df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("Scan"):
            out.append(node.metrics().get("numOutputRows").get().value())
        inner = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if name.endswith("QueryStage") else None
        children = node.children()
        nodes += [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
    return out


def test_reading_a_few_documents_reads_a_few_pages(spark, numbered):
    found = token_files.read_documents(spark, numbered, 30_000, 30_060)
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == list(range(30_000, 30_061, 3))
    lengths = {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_lengths(spark, numbered).collect()}
    assert len(lengths) == 20_000
    assert all(lengths[r.doc_id] == (r.start, len(r.ids)) for r in rows)
    assert min(scanned_rows(found)) <= 4 * token_files.PAGE_ROWS


def test_reading_lengths_leaves_the_ids_alone(spark, numbered):
    plan = token_files.read_lengths(spark, numbered)._jdf.queryExecution().executedPlan().toString()
    assert "n_tokens" in plan and "ids:array" not in plan


def test_token_files_of_nothing_and_of_long_texts(spark, docs):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs.limit(0), path)
    assert token_files.read_token_files(spark, path).count() == 0
    path, text = scratch_path(spark, "tokens"), "Long texts. " * 200_000
    token_files.write_token_files(spark.createDataFrame([(1, text)], "doc_id long, text string"), path)
    assert token_files.read_token_files(spark, path).first().n_tokens == len(library_of(token_files.VOCABULARY)(text)) + 1


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_registered_queries_against_the_libraries(spark, data):
    rows = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in rows}
    byte, word, ranks = library_of("byte_bpe_50k.json"), library_of("word_bpe_49k.json"), tiktoken_of("byte_bpe_50k.tiktoken")
    wanted, at = set(), 0
    for doc_id, text in texts.items():
        ids = [*word(text), 1]
        wanted.add((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert {tuple(r[:4]) for r in queries.op2_token_files(spark, data).collect()} == wanted
    wanted = set()
    for doc_id, text in texts.items():
        ids, at = [*byte(text), 1], 0
        for n in packing.piece_lengths(len(ids)):
            wanted.add((doc_id, at, n, crc(ids[at : at + n]), len(ids)))
            at += n
    pieces = queries.op1_packing(spark, data).collect()
    assert len(pieces) == len(wanted) and {tuple(r[:5]) for r in pieces} == wanted
    assert len({r.sequence_id for r in pieces}) == len(pieces) and {r.offset for r in pieces} == {0}
    wanted = set()
    for doc_id, text in texts.items():
        ids = ranks(text)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        wanted.add((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in queries.op3_byte_bpe(spark, data).collect()} == wanted


def test_codec_query_columns(spark, docs):
    rows = bpe.encode_decode(docs).collect()
    assert len(rows) == 6
    for r in rows:
        if r.doc_id == 1:
            assert hashlib.sha256(r.decoded).digest() == hashlib.sha256(b"Hello world. " * 900).digest()
        if r.doc_id == 2:
            assert (r.ids, r.decoded) == (b"", b"")
    assert bpe.encode_decode(docs.limit(0)).count() == 0
