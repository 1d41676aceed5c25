import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tributary.llm import simple8b, tokens


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    words, offsets = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, offsets, len(ids)).tolist() == ids


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_groups_begin_at_words_of_their_own(n):
    ids = np.random.default_rng(n).integers(0, 1 << 16, n).astype(np.uint64)
    words, offsets = simple8b.encode(ids)
    assert len(offsets) == -(-n // 128)
    for k, a in enumerate(offsets):
        b = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        part = ids[k * 128 : (k + 1) * 128]
        assert simple8b.decode(words[a:b], np.array([0]), len(part)).tolist() == part.tolist()


def test_small_ids_pack_densely():
    words, _ = simple8b.encode(np.zeros(12800, np.uint64))
    assert len(words) == 100 * 3
    words, _ = simple8b.encode(np.full(12800, 1000, np.uint64))
    assert len(words) == 100 * 22


@pytest.fixture(scope="module")
def plain():
    held = Tokenizer.from_file(tokens.vocabulary())
    held.encode_special_tokens = True
    return held


def encoded(encoder, texts):
    ids, counts = encoder.encode(*tokens.as_bytes(pa.array(texts, pa.string())))
    ends = np.cumsum(counts)
    return [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)]


ALPHABET = list(" \n\t.,;:!?'s'abZ09é×÷ñ \u0085　漢😀​\x1c\x00~|<>̀") + ["'ll", " the", "\r\n", "<|endoftext|>", "  ", "don't"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), max_size=6))
def test_encoder_equals_the_library(texts):
    held = tokens.encoder_of(tokens.vocabulary())
    want = [x.ids for x in held.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(held, texts) == want


def test_a_full_table_of_segments_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 40)
    held, rng = tokens.Encoder(tokens.vocabulary()), random.Random(3)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 5))) for _ in range(rng.randrange(0, 40))) for _ in range(5)]
        assert encoded(held, texts) == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
        assert len(held.keys) <= 40


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=200).map("".join))
def test_long_texts_in_spans(text):
    held = tokens.encoder_of(tokens.vocabulary())
    was = tokens.LONG, tokens.PIECE
    tokens.LONG, tokens.PIECE = 5, 9
    try:
        assert encoded(held, [text]) == [held.ids([text])[0]]
    finally:
        tokens.LONG, tokens.PIECE = was


def test_segments_of_equal_hash_are_told_apart(plain, monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "_hashes", lambda self, data, starts, ends: (ends - starts).astype(np.uint64) * np.uint64(1 << 40))
    held, rng = tokens.Encoder(tokens.vocabulary()), random.Random(4)
    for _ in range(10):
        texts = [" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(30)) for _ in range(3)]
        assert encoded(held, texts) == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_new_segments_are_encoded_many_in_one_text(plain, monkeypatch):
    held, rng, given_ = tokens.Encoder(tokens.vocabulary()), random.Random(6), []
    ids = held.ids
    monkeypatch.setattr(held, "ids", lambda texts: given_.extend(texts) or ids(texts))
    text = "".join(" " + "".join(rng.choices("abcdéñ", k=8)) for _ in range(5000))
    assert encoded(held, [text]) == [plain.encode(text, add_special_tokens=False).ids]
    assert len(given_) < 200


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" a", " é", " don't", " 'll", " 12", " x.y", " <|endoftext|>", " \u00a0", "  b", " ", ".", "\n", " 漢", " \x00", " \u0085z", "x" * 40, " " + "y" * 40]), max_size=60).map("".join), st.sampled_from([1, 2, 64]))
def test_joined_segments_equal_the_library(text, joined):
    was, tokens.JOINED = tokens.JOINED, joined
    try:
        held = tokens.encoder_of(tokens.vocabulary())
        held.keys, held.bytes, held.starts, held.sizes, held.seen, held.pool = (x[:0] for x in (held.keys, held.bytes, held.starts, held.sizes, held.seen, held.pool))
        assert encoded(held, [text]) == [held.tokenizer.encode(text, add_special_tokens=False).ids]
    finally:
        tokens.JOINED = was


def test_a_tokenizer_that_marks_no_spaces_encodes_apart(plain):
    held = tokens.Encoder(tokens.vocabulary())
    held.spaced[:] = False
    text = "some words and others " * 20
    assert encoded(held, [text]) == [plain.encode(text, add_special_tokens=False).ids]


def test_blocks_of_ids_are_packed_alike_whatever_is_held(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 1 << 40, 5000).astype(np.uint64) >> np.random.default_rng(6).integers(0, 40, 5000).astype(np.uint64)
    words, offsets = simple8b.encode(ids)
    monkeypatch.setattr(simple8b, "TOGETHER", 3)
    again, at = simple8b.encode(ids)
    assert (again == words).all() and (at == offsets).all() and (simple8b.decode(words, offsets, len(ids)) == ids).all()


def check(spark, rows, plain):
    """rows: (doc_id, text); documents of equal id may stand in any order among themselves."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in tokens.report(frame).collect()))
    want = {}
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [x[1] for x in got] == sorted((x[0] for x in rows), key=lambda x: (x is not None, x))
    found = {}
    for _, doc_id, n, crc in got:
        found.setdefault(doc_id, []).append((n, crc))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_query_against_brute_force(spark, small, plain):
    check(spark, [tuple(x) for x in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()], plain)


def test_edges(spark, plain):
    rows = [(5, None), (3, ""), (None, "null id"), (9, "same"), (9, "same"), (9, "other"), (-4, "<|endoftext|>"), (7, "word " * 60_000), (8, "é漢😀" * 1000), (2**62, "far")]
    check(spark, rows, plain)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.report(none).count() == 0


def test_files_alone_give_the_result(spark, tmp_path):
    frame = spark.createDataFrame([(k, "some text " * k, "x") for k in range(300)], "doc_id long, text string, shard string")
    tokens.write(frame, f"{tmp_path}/ids")
    rows = spark.read.parquet(f"{tmp_path}/ids").orderBy("shard", "block").collect()
    assert [d for x in rows for d in x.doc_ids] == list(range(300))
    assert tokens.read(spark, f"{tmp_path}/ids").count() == 300
