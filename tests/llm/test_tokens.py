import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import pieces, tokenfile

PARTS = ["a", "b", "the", "ing", "  ", " ", "   ", "\n", "\t", "é", "ß", "中", "文字", "🏽", "x1", "00", "...", "==", "́", " " * 15, " " * 40, "aaaa", "ɐ", "it's", "　", " ", "İ", "ΑΣ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext", "|>", "</w>", "<s>"]


def cases(n, seed):
    r = random.Random(seed)
    return ["", " ", "  ", "a", " a", "a ", "   a  b ", "\n"] + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(path, library):
    enc, texts = pieces.encoder(path("piece_bpe_32k.model")), cases(1500, 1)
    ids, ends = enc.batch(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t) for t in texts]
    assert pieces.decode(enc.model, ids, ends).to_pylist() == texts


@pytest.mark.parametrize("chunk,reach", [(5, 0), (7, 3), (64, 16)])
def test_chunk_scan_by_the_library(path, library, chunk, reach):
    enc = pieces.encoder(path("piece_bpe_32k.model"))
    for t in [*cases(250, 2), "a" * 100, "abcdefgh" * 12]:
        assert pieces.encode_scanned(enc, t, chunk, reach) == library.encode(t)


def test_max_plus_is_associative():
    draw = np.random.default_rng(0)
    a, b, c = (np.where(draw.random((m, n)) < 0.4, -np.inf, draw.random((m, n))) for m, n in ((3, 4), (4, 2), (2, 5)))
    assert np.allclose(pieces.max_plus(pieces.max_plus(a, b), c), pieces.max_plus(a, pieces.max_plus(b, c)))


def test_pieces_over_a_table(spark, path, library, odd_docs):
    got = {r.doc_id: r for r in pieces.piece_digests(odd_docs, path("piece_bpe_32k.model"), giant=20_000).collect()}
    for r in odd_docs.collect():
        ids = library.encode(r.text or "")
        assert (got[r.doc_id].n_pieces, got[r.doc_id].pieces_crc32, got[r.doc_id].round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    encoded = pieces.encode_documents(odd_docs, path("piece_bpe_32k.model"), giant=20_000)
    assert encoded.count() == 10 and encoded.columns == [*odd_docs.columns, "pieces"]
    back = pieces.decode_documents(encoded, path("piece_bpe_32k.model"))
    assert {(r.doc_id, r.decoded) for r in back.collect()} == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    assert pieces.encode_documents(odd_docs.limit(0), path("piece_bpe_32k.model")).count() == 0


@pytest.fixture(scope="module")
def word_library(path):
    """The library's tokenizer as it comes, apart from the one that the operator holds."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("word_bpe_49k.json"))


def test_tree_of_products():
    """The states of the best path, by trying all paths."""
    import itertools

    draw = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 6):
        sizes = [1, *draw.integers(1, 4, n - 1).tolist(), 1]
        matrices = [draw.integers(0, 50, (a, b)).astype(np.float32) for a, b in zip(sizes, sizes[1:])]
        best = max(sum(m[i, j] for m, i, j in zip(matrices, path_, path_[1:])) for path_ in itertools.product(*map(range, sizes)))
        states = pieces.scan(matrices)
        assert len(states) == n + 1 and sum(m[i, j] for m, i, j in zip(matrices, states, states[1:])) == best


def test_giants_in_levels(spark, path, library):
    """Many small chunks, three of them to a product, so that the tree has several levels in Spark."""
    texts = [t for t in cases(40, 9) if t] + ["a" * 150, "abcdefgh" * 40, " ".join(cases(20, 10)), "x"]
    rows = spark.createDataFrame([(str(k).encode(), t) for k, t in enumerate(texts)], "key binary, text string")
    got = pieces.encode_giants(rows.union(rows.limit(3)), path("piece_bpe_32k.model"), 7, 3, 3).toPandas().sort_values(["key", "k"])
    ids = {k: np.concatenate([np.frombuffer(b, "<u4") for b in f["ids"]]).tolist() for k, f in got.groupby(got["key"].map(bytes))}
    assert got["k"].max() > 27 and ids == {str(k).encode(): library.encode(t) for k, t in enumerate(texts)}


def test_pieces_keep_all_columns(spark, path, library):
    """Names that the operator might use for itself, on both sides of GIANT."""
    rows = spark.createDataFrame([(1, "a b " * 50, 5, 6, 7, "x"), (2, "a", 5, 6, 7, "y"), (3, "a b " * 50, 5, 6, 7, "z")], "doc_id long, text string, _key int, key0 int, KEY1 int, `k.e` string")
    got = pieces.encode_documents(rows, path("piece_bpe_32k.model"), giant=100)
    assert got.columns == [*rows.columns, "pieces"]
    assert sorted((r[0], r[2], r[5], np.frombuffer(r[6], "<u4").tolist()) for r in got.collect()) == [(k, 5, n, library.encode(t)) for k, t, n in ((1, "a b " * 50, "x"), (2, "a", "y"), (3, "a b " * 50, "z"))]


def test_token_ids_are_those_of_the_library(path, word_library):
    texts = [*cases(2500, 3), "a <|endoftext|> b", "<|startoftext|>x", "wo<|endoftext|>rd it<|endoftext|>'s", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <|StartOfText|>"]
    ids, ends = tokenfile.encode_texts(pa.array(texts, pa.large_string()), path("word_bpe_49k.json"), 2)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [word_library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids[ends[len(texts) - 5] : ends[len(texts) - 4]].tolist() == [320, 49407, 321, 2]


def test_plain_words_beside_special_ones(path, word_library):
    """Special tokens amid many plain words, which are encoded together."""
    texts = [" ".join(f"word{i}<|endoftext|>" if i % 7 == 0 else f"plain{i}'s." for i in range(300))]
    ids, _ = tokenfile.encode_texts(pa.array(texts, pa.large_string()), path("word_bpe_49k.json"), 2)
    assert ids.tolist() == word_library.encode(texts[0], add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    coded, _ = tokenfile.EliasFano.load(memoryview(tokenfile.EliasFano.of(np.array(values, np.uint64)).dump()), 0)
    assert coded.block(0, coded.n).tolist() == values and all(coded.select(i) == values[i] for i in range(0, len(values), 37))
    for first, count in ((0, 1), (1, 256), (255, 2), (256, 300), (len(values) - 1, 5), (len(values), 3)):
        if first >= 0:
            assert coded.block(first, count).tolist() == values[first : first + count]


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 50_000))
    assert len(tokenfile.EliasFano.of(values).dump()) * 8 / len(values) < 2.3 + np.log2((1 << 30) / len(values))


def test_shard():
    shard = tokenfile.make_shard([None, -5, -5, 9], np.array([1, 3, 0, 2]), np.arange(6, dtype="<u2"))
    back = tokenfile.Shard.load(shard.dump())
    assert back.keys(0, 9) == [None, -5, -5, 9] and back.keys(1, 2) == [-5, -5] and [(k, b.tolist()) for k, b in back.blocks(3)] == [([None, -5, -5], [0, 1, 4, 4]), ([9], [4, 6])] and back.document(1).tolist() == [1, 2, 3] and back.document(2).tolist() == [] and back.document(3).tolist() == [4, 5]
    with pytest.raises(ValueError):
        tokenfile.Shard.load(b"nonsense" * 20)


def check_files(spark, docs, path, library):
    got = sorted(tokenfile.token_files(docs, path("word_bpe_49k.json"), 2).collect(), key=lambda r: r.start)
    at, left = 0, {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        left.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted((k for k, v in left.items() for _ in v), key=lambda k: (k is not None, k or 0))
    for r in got:
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        assert r.start == at
        at += r.n_tokens


def test_token_files(spark, path, odd_docs, word_library, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 300)
    check_files(spark, odd_docs, path, word_library)
    assert tokenfile.token_files(odd_docs.limit(0), path("word_bpe_49k.json"), 2).count() == 0


def test_token_files_in_many_ranges(spark, path, word_library, monkeypatch, make_text):
    """Small ranges, of which some end amid the rows of one id or without one; blocks of two boundaries."""
    for name, value in (("SHARD_IDS", 100), ("RANGE_BYTES", 200), ("BLOCK", 2)):
        monkeypatch.setattr(tokenfile, name, value)
    rows = [(None if k % 5 == 0 else 7 if k % 5 == 1 else k - 50, make_text(k % 60, k % 11) + (" <|endoftext|>" if k % 9 == 0 else "")) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    edges = tokenfile._edges(docs.withColumn("h", F.xxhash64("text")))
    assert edges[2] > 20 and (np.diff(edges[0]) == 0).any()
    check_files(spark, docs, path, word_library)
