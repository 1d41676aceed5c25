import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tributary.llm import textcore

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 .é漢\n_'", max_size=30)), max_size=8))
def test_words(texts):
    w = textcore.Words(*textcore.as_bytes(pa.array(texts, pa.string())))
    want = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for part in want for x in part]
    assert [w.text(k, 1).decode() for k in range(len(flat))] == flat
    same = {}
    for word, h in zip(flat, w.hashes.tolist(), strict=True):
        assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)


def test_hashes_do_not_depend_on_the_span(monkeypatch):
    data = np.random.default_rng(0).choice(np.frombuffer(b"abc ", np.uint8), 40_000)
    starts, ends = textcore.runs(data != 32, np.array([0]))
    whole = textcore.hashes(textcore.BYTE_VALUES, data, starts, ends)
    for span in (1, 50, 20_000):
        monkeypatch.setattr(textcore, "SPAN", span)
        assert (textcore.hashes(textcore.BYTE_VALUES, data, starts, ends) == whole).all()


def test_slices_and_large_strings():
    column = pa.array(["one", None, "two é", ""])
    for c in (column.slice(1, 3), column.slice(1, 3).cast(pa.large_string())):
        data, offsets = textcore.as_bytes(c)
        assert data.tobytes() == "two é".encode() and offsets.tolist() == [0, 0, 6, 6]
    assert [x for x in textcore.pieces(np.array([0, 5, 6, 100, 101]), 10)] == [(0, 2), (2, 3), (3, 4)]
    assert list(textcore.pieces(np.array([0]), 10)) == []


def test_tallies_and_spans(monkeypatch):
    data = np.random.default_rng(1).choice(np.frombuffer(b"ab1 ", np.uint8), 5000)
    starts, ends = textcore.runs(data != 32, np.array([0]))
    digit = np.zeros(256, bool)
    digit[ord("1")] = True
    want = [int((data[a:b] == ord("1")).sum()) for a, b in zip(starts, ends, strict=True)]
    for span in (1, 50, 20_000):
        monkeypatch.setattr(textcore, "SPAN", span)
        assert textcore.tally(digit, data, starts, ends).tolist() == want
        assert (textcore.word_hashes(data) == textcore.Words(data, np.array([0, len(data)])).hashes).all()
    kinds = (textcore.WORD != 0).astype(np.uint8)
    cuts = list(textcore.spans(data, kinds, 100))
    assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(data)
    assert all(kinds[data[b]] == 0 or kinds[data[b]] != kinds[data[b - 1]] for _, b in cuts[:-1])
    assert list(textcore.spans(np.full(10**6, 97, np.uint8), kinds, 100)) == [(0, 10**6)]
