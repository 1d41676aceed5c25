import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.oracle import actual, expected
from tributary.llm import decontaminate as op
from tributary.llm import shared
from tributary.llm.textcore import Words, as_bytes, grams

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item) if item_id is not None and item is not None else []
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = op.report(d, b)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(docs, items)


def sentence(rng, n, vocabulary=12):
    return " ".join(rng.choice(["ab", "Cd", "é1", "x9", "漢字", "q", "zz", "The", "of", "ñ", "7", "mm"][:vocabulary]) + rng.choice(["", ".", ",", "!"]) for _ in range(n))


def test_against_the_oracle(spark, small):
    assert actual(op.op1_decontaminate(spark, small)) == expected(op.ORACLE, small)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(k, sentence(rng, rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(8)]
    docs = [(k, sentence(rng, rng.randrange(0, 60)) + " " + rng.choice(items)[1] + " " + sentence(rng, 5)) for k in range(30)]
    docs += [(100 + k, sentence(rng, 400, 3)) for k in range(3)]  # much repetition
    check(spark, docs, items)


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = [(1, item), (1, item), (2, None), (None, "lone words here"), (3, ""), (4, "..."), (5, "ONE"), (12, item + " twelve")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, item.upper()), (4, item.upper()), (None, item), (5, " ".join(item.split()[:10])), (6, " ".join(item.split()[:9])), (7, "x " * 50_000 + item + " y" * 50_000)]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


def test_a_shared_span_across_documents_is_no_hit(spark):
    item = "a b c d e f g h i j"
    check(spark, [(1, "a b c d e"), (2, "f g h i j"), (3, item)], [(9, item)])


def test_every_shared_span_of_ten_has_a_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = " ".join(map(str, rng.integers(0, 40, 10)))
        texts = [" ".join(map(str, rng.integers(0, 40, 30))) + " " + shared + " " + " ".join(map(str, rng.integers(0, 40, 30))) for _ in range(2)]
        marks = []
        for text in texts:
            w = Words(*as_bytes(pa.array([text])))
            five, _ = grams(w.hashes, w.row, op.GRAM)
            _, inside = grams(w.hashes, w.row, op.WINDOW)
            marks.append(set(five[op.winnow(five, inside)].tolist()))
        assert marks[0] & marks[1]


def test_full_sieves_and_hot_windows_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [(k, sentence(rng, 14)) for k in range(20)] + [(99, sentence(rng, 3))]
    docs = [(k, sentence(rng, 20) + " " + items[k % 20][1] + " " + items[(k * 7) % 20][1]) for k in range(25)] + [(50 + k, sentence(rng, 9) + " " + items[0][1]) for k in range(20)]
    monkeypatch.setattr(op.Sieve, "may", lambda self, hashes: np.ones(len(hashes), bool))
    monkeypatch.setattr(shared, "HOT_LEAST", 3)
    check(spark, docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clean = {x[0] for x in brute(docs, items) if not x[-1]}
    assert {x.doc_id for x in op.decontaminate(d, b).collect()} == clean


def test_a_sieve_lets_through_what_it_was_made_of(spark):
    g = np.random.default_rng(6)
    values = g.integers(0, 1 << 64, 5000, dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in values[:2500].view(np.int64)], "h long")
    held = op.Sieve(frame, "h")
    assert held.may(values[:2500]).all() and held.may(values[2500:]).mean() < 0.01
    assert not op.Sieve(frame.where("1 = 0"), "h").may(values).any()


def test_filter_keeps_columns_and_clean_documents(spark):
    rows = [(1, "clean text", "n", 1), (2, "a b c d e f g h i j", "n", 2), (3, None, None, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(1, "A, b c d e f g h i j k")], "item_id long, text string")
    out = op.decontaminate(d, b)
    assert out.columns == d.columns
    assert sorted(tuple(x) for x in out.collect()) == [rows[0], rows[2]]
