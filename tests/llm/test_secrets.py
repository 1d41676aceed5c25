import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tributary.llm import secret_scan as op

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16),
    ("hex", re.compile(r"[0-9a-f]+"), 32),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[2] if k == 0 else m[0]) >= least)


def spelled(spans):
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None, "", "password=hunter22x", 'API_KEY: "abcd1234efgh"', "token = short", "ſecret=abcdefgh1", "toKen=abcdefgh1", "é漢password:'x1y2z3w4'é", "AKIA" + "A1" * 6, "AKIA" + "A" * 11, "AKIAAKIAAKIAAKIA",
    "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "0", "F" * 40, "x" + "a" * 31 + "g", "secret=" + "ab12" * 10, "password==abcdefgh", "passwd password=secret=abcdefghij", "token:token:abcdefghi", "n\n".join(["apikey=12345678"] * 3),
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdefgh", "0123456789abcdef", "AKIA", "A1B2C3", "é", "漢", "\n", ".", "-"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(3000)]
    got = op.scan(pa.array(texts), None)
    for text, (base, added) in zip(texts, got, strict=True):
        assert sorted(base) == brute(text), text
        assert added == []


def test_query_against_brute_force(spark, small):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op.op4_secrets(spark, small).collect()
    assert len(rows) == len(texts)
    for x in rows:
        want = brute(texts[x.doc_id])
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert x.base_sha256 == hashlib.sha256(spelled(want).encode()).hexdigest()
        spans = [y.split(":") for y in x.spans.split(",") if y]
        assert ",".join(":".join(y) for y in spans if y[0] != "crf") == spelled(want)
        for kind, a, b in spans:  # added spans lie apart from base ones
            assert kind != "crf" or all(int(b) <= s or int(a) >= e for s, _, e in want)


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(TEXTS)] + [(2, "password=hunter22x", "mine"), (None, "x " * 100_000 + "password=hunter22x", None)], "doc_id long, text string, spans string")
    for model in (op.fit(docs), None):
        rows = op.report(docs, model).collect()
        assert len(rows) == len(TEXTS) + 2
        last = next(x for x in rows if x.doc_id is None)
        assert last.n_assign == 1 and "assign:200000:200018" in last.spans
    none = docs.where("1 = 0")
    assert op.report(none, op.fit(none)).count() == 0


def brute_viterbi(chain, model):
    pairs, start = model._limits()
    scores = sum(model.weights[f] for f in chain.features)
    out, k = [], 0
    while k < len(scores):
        end = k + 1
        while end < len(scores) and not chain.first[end]:
            end += 1
        best, back = start + scores[k], []
        for t in range(k + 1, end):
            moved = best[:, None] + pairs
            back.append(moved.argmax(axis=0))
            best = moved.max(axis=0) + scores[t]
        tags = [int(best.argmax())]
        for pointers in reversed(back):
            tags.append(int(pointers[tags[-1]]))
        out += tags[::-1]
        k = end
    return out


def test_viterbi_over_blocks_is_exact():
    rng = random.Random(2)
    for seed in range(30):
        g = np.random.default_rng(seed)
        model = op.Crf()
        model.weights, model.pairs, model.start = (g.normal(0, 1, x.shape).astype(np.float32) for x in (model.weights, model.pairs, model.start))
        texts = [" ".join(rng.choices(["a", "bb1", "=", "\n", "Zz9", "é"], k=rng.randrange(0, 400))) for _ in range(3)]
        chain = op.Chain(*op.as_bytes(pa.array(texts)))
        assert model.decode(chain).tolist() == brute_viterbi(chain, model)


def test_gradient_is_that_of_the_likelihood():
    g = np.random.default_rng(3)
    model = op.Crf()
    model.pairs = g.normal(0, 1, (3, 3)).astype(np.float32)
    scores, live = g.normal(0, 1, (1, 3, 3)), np.ones((1, 3), bool)
    pairs, start = model._limits()
    paths = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    weight = np.array([np.exp(start[a] + scores[0, 0, a] + pairs[a, b] + scores[0, 1, b] + pairs[b, c] + scores[0, 2, c]) for a, b, c in paths])
    node, pair = model._expected(scores, live)
    for t in range(3):
        for tag in range(3):
            assert np.isclose(node[0, t, tag], weight[[p[t] == tag for p in paths]].sum() / weight.sum(), atol=1e-6)
    for a in range(3):
        for b in range(3):
            want = sum(w * ((p[0], p[1]) == (a, b)) + w * ((p[1], p[2]) == (a, b)) for w, p in zip(weight, paths, strict=True)) / weight.sum()
            assert np.isclose(pair[a, b], want, atol=1e-6)


def test_the_model_adds_keys_without_a_pattern(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = op.fit(docs)
    rng = np.random.default_rng(77)
    hits = 0
    for _ in range(40):
        key = op._made_up(rng)
        ((base, added),) = op.scan(pa.array([f"That and the others key: {key} in the end of it."]), model)
        hits += any(a <= 25 and b >= 25 + len(key) for a, _, b in base + added)
    assert hits >= 34
    clean = op.scan(pa.array(["The quick brown fox jumps over the lazy dog, and then it sleeps.", "Er sagt: das ist gut so."]), model)
    assert all(not a and not b for a, b in clean)


def test_long_texts_in_spans(monkeypatch):
    rng = random.Random(5)
    g = np.random.default_rng(6)
    model = op.Crf()
    model.weights, model.pairs = (g.normal(0, 1, x.shape).astype(np.float32) for x in (model.weights, model.pairs))
    parts = ["a", "bb1", "=", "\n", "\n\n", "Zz9", "é", "password=hunter22x", "k3y_abcdefgh", " "]
    texts = ["".join(rng.choices(parts, k=300)) for _ in range(5)]
    whole = [op.scan(pa.array([t]), model)[0] for t in texts]
    with monkeypatch.context() as m:  # lines are shorter than spans
        m.setattr(op, "LONG", 50)
        m.setattr(op, "PIECE", 400)
        assert [op.scan(pa.array([t]), model)[0] for t in texts] == whole
    monkeypatch.setattr(op, "LONG", 50)
    monkeypatch.setattr(op, "PIECE", 60)
    line = "".join(rng.choices([x for x in parts if "\n" not in x], k=400))
    base, added = op.scan(pa.array([line]), model)[0]
    assert sorted(base) == brute(line) and all(a < b <= len(line) for a, _, b in added)


def test_added_spans_lie_apart_from_base_ones():
    rng = random.Random(7)
    for _ in range(300):
        found = sorted((a, 0, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6))))
        more = sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(5)))
        assert op._clear(found, more) == [(a, b) for a, b in more if all(b <= x or a >= y for x, _, y in found)]


def test_rare_matches_are_found_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE", 3)
    monkeypatch.setattr(op, "AHEAD", 1)
    rows = [f"plain words number {k}" for k in range(400)] + [f"here password=hunter{k}22x" for k in range(6)]
    seen = []
    monkeypatch.setattr(op.Crf, "fit", lambda self, index, tags, mask: seen.append(int((tags == 1).any(axis=1).sum())))
    op.fit(spark.createDataFrame([(x,) for x in rows], "text string").repartition(4))
    assert seen and seen[0] >= 3
