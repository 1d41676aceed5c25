import random

import numpy as np
import pyarrow as pa
from tests.llm.test_decontaminate import words

from tributary.llm import neardup as op
from tributary.llm import shared, textcore
from tributary.llm.textcore import as_bytes


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def brute(rows):
    """Sets of row numbers, by links of plain Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    return parent, root


def check(spark, rows):
    got = op.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    _, root = brute(rows)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(doc_id)
    want = sorted(((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g), key=str)
    assert sorted(((x.doc_id, x.class_id) for x in got), key=str) == want


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n))


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        base = text(rng, rng.choice([6, 40, 150, 300]))
        rows.append(base)
        for _ in range(rng.randrange(0, 5)):
            rows.append(edited(rng, base, 1) if len(base.split()) > 60 else base.upper() + "!")
        rows.append(edited(rng, base, max(3, len(base.split()) // 8)))  # a decoy
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_a_large_group_and_a_common_passage(spark):
    rng = random.Random(5)
    base, passage = text(rng, 200), text(rng, 60)
    rows = [edited(rng, base, 1) for _ in range(300)] + [text(rng, 120) + " " + passage for _ in range(200)] + [text(rng, 80) for _ in range(100)]
    got = op.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    named = {x.doc_id: x.class_id for x in got}
    assert {named[k] for k in range(300)} == {0}
    assert all(named[k] == k for k in range(300, 600))


def test_links_within_a_large_group_of_one_template(spark):
    rng = random.Random(8)
    template, fresh = text(rng, 89), iter(range(10**6))
    own = lambda n: "".join(f" own{next(fresh)}" for _ in range(n))
    rows = []
    for _ in range(300):  # 85 of 100 shingles are everybody's (0.74); a pair has 91 in common (0.835)
        pair = template + own(6)
        rows += [pair + own(9), pair + own(9)]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_blocks_of_several_chunks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 40)
    monkeypatch.setattr(op, "STREAM", 50)
    test_links_within_a_large_group_of_one_template(spark)


def test_a_block_links_every_member_and_not_only_the_nearest():
    g = np.random.default_rng(3)
    base = np.sort(g.integers(0, 1 << 63, 100).astype(np.uint64))
    signs, weight = np.zeros(op.SAMPLES, np.uint32), np.ones(100)
    far = np.where(np.arange(op.SAMPLES) < 44, 0, 1).astype(np.uint32)  # estimates far below those of the others
    held = [(k, k, signs if k else far, base, weight) for k in range(30)]
    assert [x[:2] for x in op._Block(held).links(0, False, 50, 50, signs, base, weight)] == [(k, 50) for k in range(30)]
    assert op._Block(held).links(1, False, 50, 50, signs, base, weight) == []
    assert [x[:2] for x in op._Block(held).links(0, False, 10, 5, signs, base, weight)] == [(k, 10) for k in range(10) if k != 5]


def test_edges(spark):
    rng = random.Random(6)
    long = text(rng, 30_000)
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "one"), (5, "ONE."), (5, "one"), (6, "a b c d"), (7, "a b c d e"), (None, "null id text of some more words"), (8, "null id text of some more words"), (9, long), (10, edited(rng, long, 20)), (10, long), (11, "lone words that nobody else has")]
    check(spark, rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.classes(none).count() == 0
    assert op.classes(none.unionByName(spark.createDataFrame([(1, None)], "doc_id long, text string"))).count() == 1


def test_keep_one(spark):
    rng = random.Random(7)
    base = text(rng, 100)
    rows = [(3, base, "a"), (3, base, "a"), (1, edited(rng, base, 1), "b"), (2, base.upper(), "c"), (8, "other words " * 20, "d"), (9, None, "e"), (9, None, "e"), (None, "without an id but words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(x) for x in kept.collect()), key=str) == sorted([rows[2], rows[4], rows[5], rows[6], rows[7]], key=str)
    same = spark.createDataFrame([(5, base)] * 7, "doc_id long, text string")
    assert [x.doc_id for x in op.keep_one(same).collect()] == [5]


def test_samples_agree_as_the_weighted_similarity():
    g = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        agree, truth = [], []
        for _ in range(40):
            a = g.integers(0, 1 << 63, 300).astype(np.uint64)
            m = int(600 * share / (1 + share))
            b = np.concatenate([a[:m], g.integers(0, 1 << 63, 300 - m).astype(np.uint64)])
            wa = g.uniform(1, 3, 300)
            wb = np.concatenate([wa[:m] * g.choice([1, 1, 1.3], m), g.uniform(1, 3, 300 - m)])
            agree.append((op.samples(a, wa, np.array([0])) == op.samples(b, wb, np.array([0]))).mean())
            ia, ib = np.argsort(a), np.argsort(b)
            truth.append(op.similarity((a[ia], wa[ia]), (b[ib], wb[ib])))
        assert abs(np.mean(agree) - np.mean(truth)) < 0.03


def test_samples_do_not_depend_on_chunks(monkeypatch):
    g = np.random.default_rng(2)
    value, weight = g.integers(0, 1 << 63, 1000).astype(np.uint64), g.uniform(1, 2, 1000)
    first = np.array([0, 10, 11, 500])
    whole = op.samples(value, weight, first)
    monkeypatch.setattr(op, "_CHUNK", 64)
    assert (op.samples(value, weight, first) == whole).all()


def test_components_of_a_long_chain(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150)]
    got = {x.node: x.label for x in op.components(spark.createDataFrame(pairs, "low long, high long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100}


def test_a_document_counts_once_in_a_frequency():
    rows = ["a b c d e " * 1000, "one two", "one two", None, "x y z v w"]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"])
    (got,) = op._frequencies(iter([batch]))
    assert sorted(got.column(1).to_pylist()) == [1, 1, 1, 1, 1, 1, 2]


def test_long_texts_in_spans(monkeypatch):
    rng = random.Random(9)
    for t in (text(rng, 500) + " é漢 a b a b a b a b", "one, two", "!" * 50, "x" * 500 + " y"):
        data, offsets = as_bytes(pa.array([t]))
        want = op.shingles(data, offsets)
        with monkeypatch.context() as m:
            m.setattr(op, "LONG", 5)
            m.setattr(op, "PIECE", 7)
            m.setattr(textcore, "SPAN", 64)
            got = op.shingles(data, offsets)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_hot_keys_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_LEAST", 3)
    monkeypatch.setattr(op, "ALL_PAIRS", 4)
    monkeypatch.setattr(op, "GROUP", 2)
    rng = random.Random(10)
    base = text(rng, 120)
    rows = [edited(rng, base, 1) for _ in range(12)] + [base] * 6 + [text(rng, 50) for _ in range(6)]
    docs = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(rows)], "doc_id long, text string, node long, `class_id` string")
    named = {x.doc_id: x.class_id for x in op.classes(docs).collect()}
    assert {named[k] for k in range(18)} == {0} and all(named[k] == k for k in range(18, 24))
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [0, *range(18, 24)]


def test_hot_keys_are_counted_without_a_join(spark, monkeypatch):
    count, plans = shared.hot_keys, []

    def counted(counts, *key):
        plans.append(counts._jdf.queryExecution().optimizedPlan().toString())
        return count(counts, *key)

    monkeypatch.setattr(shared, "hot_keys", counted)
    rng = random.Random(11)
    base = text(rng, 120)
    rows = [edited(rng, base, 1) for _ in range(30)] + [text(rng, 50) for _ in range(6)]
    named = {x.doc_id: x.class_id for x in op.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert {named[k] for k in range(30)} == {0} and all(named[k] == k for k in range(30, 36))
    assert plans and not [x for x in plans if "Join" in x]  # a frame that is not cut would run its joins again


def test_candidates_grow_with_a_group_and_not_with_its_square(spark):
    rng = random.Random(12)
    base = text(rng, 150)
    docs = [(k, edited(rng, base, 2)) for k in range(400)]

    def pairs(n):
        frame = spark.createDataFrame(docs[:n], "doc_id long, text string")
        nodes = op.texts(frame, op.idf_table(frame))[1]
        return op.candidates(nodes)[0].count()

    small, large = pairs(200), pairs(400)
    assert large < 3 * small and large <= 400 * 3 * op.BANDS
