import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tributary.llm import langid, quality


def held(doc_id, modulus, value):
    return zlib.crc32(str(doc_id).encode()) % modulus == value


def test_language_of_held_out_documents(spark, medium):
    rows = langid.op3_language_id(spark, medium).collect()
    truth = {x.doc_id: x.lang for x in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(x.held_out == held(x.doc_id, 4, 2) and 0 <= x.score <= 1 for x in rows)
    out = [x for x in rows if x.held_out and x.lang_pred != "und"]
    assert len(out) > 100 and np.mean([x.lang_pred == truth[x.doc_id] for x in out]) > 0.97


def test_language_edges(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    more = [(100, None, "en"), (101, "", None), (102, "123 !?", "fr"), (None, "the the and", "en"), (103, "the dog " * 30_000, None), (103, "the dog " * 30_000, None), (104, "漢字", None)]
    docs = spark.createDataFrame([(*x, "a") for x in rows + more], "doc_id long, text string, lang string, score string")
    found = langid.annotate(docs, langid.fit(langid.learnable(docs)))
    got = [(x.row.doc_id, x.lang_pred, x.score) for x in found.collect()]
    assert len(got) == len(rows) + len(more)
    by = {}
    for doc_id, lang, score in got:
        by.setdefault(doc_id, []).append((lang, score))
    assert by[100] == [("und", 0.0)] and by[101] == [("und", 0.0)] and by[102] == [("und", 0.0)]
    assert by[None][0][0] == "en" and [x[0] for x in by[103]] == ["en", "en"] and by[104][0][0] in ("en", "fr")
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id").isin(100, 101, 102)).isEmpty()
    assert kept.where("doc_id < 100").count() == 40


def test_language_of_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [x.lang_pred for x in langid.annotate(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.annotate(docs.where("1 = 0"), langid.fit(docs.where("1 = 0"))).count() == 0


def test_bayes_against_brute_force():
    texts, langs = ["abab", "bcb", "cc"], ["x", "y", "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "text"])
    counts = {}
    for out in langid._count(iter([batch])):
        for lang, bucket, n in zip(*[c.to_pylist() for c in out.columns], strict=True):
            counts[lang, bucket] = n
    table = np.full((langid.BUCKETS, 2), langid.SMOOTHING)
    for (lang, bucket), n in counts.items():
        table[bucket, "xy".index(lang)] += n
    model = langid.Model(["x", "y"], np.log(table / table.sum(axis=0)))
    best, score = model.scores(["abc", "cb", ""])
    for k, text in enumerate(["abc", "cb"]):
        _, buckets = langid.ngrams([text])
        logs = model.matrix[buckets].sum(axis=0)
        p = np.exp(logs - logs.max())
        assert best[k] == logs.argmax() and np.isclose(score[k], p.max() / p.sum())
    assert np.isclose(score[2], 0.5)
    assert len(langid.ngrams(["abcd"])[1]) == 4 + 3 + 2


def test_quality_of_held_out_documents(spark, medium):
    rows = quality.op2_quality(spark, medium).collect()
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{medium}/documents.parquet").count()
    assert all(x.held_out == held(x.doc_id, 5, 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    out = [(x.score, labels[x.doc_id]) for x in rows if x.held_out and x.doc_id in labels]
    good, bad = [s for s, y in out if y == 1], [s for s, y in out if y == 0]
    assert np.mean([[a > b for a in good] for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_quality_edges(spark):
    good, junk = "words of a plain sentence that goes on", "THIS!! IS!! JUNK!!"
    docs = spark.createDataFrame([(k, good if k % 2 else junk) for k in range(200)] + [(900, None), (901, ""), (None, good), (902, junk * 5000), (902, junk * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(3, None), (5, 1), (5, 1), (None, 1), (5000, 0)], "doc_id long, quality int")
    found = quality.annotate(docs.withColumn("quality_score", F.lit("mine")), quality.fit(docs, quality.learnable(labels))).collect()
    assert len(found) == 205
    score = {x.row.doc_id: x.quality_score for x in found}
    assert score[1] > 0.9 and score[0] < 0.1 and score[902] < 0.3 and all(0 <= x <= 1 for x in score.values())
    assert score[900] == score[901]
    empty = quality.fit(docs.where("1 = 0"), quality.learnable(labels.where("1 = 0")))
    assert {x.quality_score for x in quality.annotate(docs, empty).collect()} == {0.5}


def test_labels_of_the_held_out_part_are_not_learned(spark):
    labels = spark.createDataFrame([(k, 1) for k in range(500)], "doc_id long, quality int")
    assert {x.doc_id for x in quality.learnable(labels).collect()} == {k for k in range(500) if not held(k, 5, 0)}


def test_random_indexing_against_brute_force():
    text = "a b a c ! b"
    sums = list(quality._sums(iter([pa.RecordBatch.from_arrays([pa.array([text, None, "a b"])], names=["t"])])))[0]
    total = np.zeros((quality.BUCKETS, quality.DIM), np.int64)
    for one in (text, "a b"):
        t = quality.Tokens(*quality.as_bytes(pa.array([one])))
        index = t.index()
        for k in range(len(t.bucket)):
            for j in range(max(0, k - quality.REACH), min(len(t.bucket), k + quality.REACH + 1)):
                if j != k:
                    for place, sign in index:
                        total[t.bucket[k], place[j]] += sign[j]
    got = np.zeros_like(total)
    got[sums["bucket"].to_numpy()] = np.stack([sums[f"v{k}"].to_numpy() for k in range(quality.DIM)], axis=1)
    assert (got == total).all()


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcé "), 1000))
    whole = langid.counted([text])
    for piece in (1, 2, 3, 7, 100, 999):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.counted([text]) == whole).all()


def brute_grams(text):
    out = {}
    low = text.lower()
    for n in (1, 2, 3):
        for k in range(len(low) - n + 1):
            h = 0
            for c in low[k : k + n]:
                h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
            x = (h + n) % (1 << 64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                x = (x ^ (x >> shift)) * factor % (1 << 64)
            out[x >> 50] = out.get(x >> 50, 0) + 1
    return out


def test_language_scores_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choices("abcdé 漢." if k % 2 else "xyzaÉ ,", k=rng.randrange(1, 60))), "one" if k % 2 else "two") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {"one": {}, "two": {}}
    for doc_id, text, lang in rows:
        if not held(doc_id, 4, 2):
            for b, n in brute_grams(text).items():
                counts[lang][b] = counts[lang].get(b, 0) + n
    total = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    found = {x.row.doc_id: x for x in langid.annotate(docs, langid.fit(langid.learnable(docs))).collect()}
    for doc_id, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert found[doc_id].lang_pred == "und"
            continue
        logs = {x: sum(n * math.log((counts[x].get(b, 0) + 0.5) / total[x]) for b, n in brute_grams(text).items()) for x in counts}
        best = max(logs, key=logs.get)
        assert found[doc_id].lang_pred == best
        assert abs(found[doc_id].score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-9


def brute_features(text, vectors, weight):
    """The numbers of a text, word by word."""
    words = [m[0] for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode())]
    hashed = [int(quality.Tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes[0]) for w in words]
    mean, shapes, total = np.zeros(quality.DIM), np.zeros(8), 0.0
    for w, h in zip(words, hashed, strict=True):
        mean += vectors[h >> 51] * weight[h >> 51]
        total += weight[h >> 51]
        upper, digit = sum(65 <= b <= 90 for b in w), sum(48 <= b <= 57 for b in w)
        mark = not re.match(rb"[A-Za-z0-9\x80-\xff]", w)
        kind = (7 if len(w) > 1 else 6) if mark else (4 if digit == len(w) else 5) if digit else min(upper, 1) if upper < 2 and upper != len(w) else (1 if upper == 1 else 2 if upper == len(w) else 3)
        shapes[kind] += 1
    n = max(1, len(words))
    unlike = len(set(hashed)) / n
    again = sum(a == b for a, b in zip(hashed, hashed[1:], strict=False)) / n
    return np.array([*(mean / max(total, 1e-9)), *(shapes / n), math.log1p(len(words)), unlike, again, math.log1p(sum(map(len, words)) / n), unlike * math.log1p(len(words))])


def test_quality_scores_against_brute_force(monkeypatch):
    g, rng = np.random.default_rng(2), random.Random(3)
    vectors, weight = g.normal(size=(quality.BUCKETS, quality.DIM)), g.uniform(size=quality.BUCKETS)
    parts = ["word", "Word", "WORD", "wOrD", "A", "7", "x9", "!", "...", " ", "  ", "\n", "é", "漢", "word word"]
    texts = ["", " ", "one", *["".join(rng.choices(parts, k=rng.randrange(1, 80))) for _ in range(60)]]
    want = np.array([brute_features(t, vectors, weight) for t in texts])
    assert np.allclose(quality.features(pa.array(texts), vectors, weight), want)
    assert np.allclose(quality.features(pa.array([None], pa.string()), vectors, weight), want[:1])
    with monkeypatch.context() as m:  # each text in spans
        m.setattr(quality, "LONG", 1)
        m.setattr(quality, "PIECE", 5)
        assert np.allclose(np.concatenate([quality.features(pa.array([t]), vectors, weight) for t in texts]), want)
    net = quality.Network(want, np.arange(len(want)) % 2)
    z = np.clip((want - net.mean) / net.scale, -8, 8)
    for k, x in enumerate(want):
        words = round(math.expm1(x[quality.DIM + 8]))
        scaled = [v * math.sqrt(words / (words + quality.SHRINK)) for v in z[k]]
        hidden = [math.tanh(sum(v * net.p[0][i][j] for i, v in enumerate(scaled)) + net.p[1][j]) for j in range(quality.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0]) / net.temperature
        assert abs(net.scores(want)[k] - 1 / (1 + math.exp(-logit))) < 1e-9
