import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_neardup import shingles
from tributary.llm import decontaminate, langid, mixing, neardup, tokens


def test_stages_against_each_other(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], small).cache())
        assert kept[-1].columns == names
    ids = [{x.doc_id for x in k.select("doc_id").collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4]
    found = langid.annotate(docs, langid.fit(langid.learnable(docs))).collect()
    assert ids[1] == {x.row.doc_id for x in found if x.lang_pred != "und" and x.score >= langid.KEEP_SCORE}
    classes = neardup.classes(kept[1]).collect()
    assert ids[2] == {x.doc_id for x in classes if x.doc_id == x.class_id} and kept[2].count() == len(ids[2])
    texts = {x.doc_id: x.text for x in docs.collect()}
    left = [shingles(texts[k]) for k in ids[2]]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(left) for b in left[:k])
    items = [tuple(x) for x in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids[3] == {x[0] for x in brute([(k, texts[k]) for k in ids[2]], items) if not x[5]}
    copies = {x.row.doc_id: x["copies"] for x in mixing.copies(kept[3]).collect()}
    assert {x.doc_id: x["count"] for x in kept[4].groupBy("doc_id").count().collect()} == {k: n for k, n in copies.items() if n}
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], small).collect()
    held = tokens.Encoder(tokens.vocabulary()).tokenizer
    at = 0
    for x in sorted(last, key=lambda x: x.start):
        want = [*held.encode(texts[x.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += x.n_tokens
    assert sorted(x.doc_id for x in last) == sorted(x.doc_id for x in kept[4].collect())


def test_run_and_registration(spark, small):
    found = __spark_entry__.queries()
    assert found["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert sorted(x.split("_")[0] for x in found if x.startswith("op")) == sorted(f"op{n}" for n in range(1, 11))
    rows = corpus_pipeline.run(spark, small).collect()
    assert len(rows) > 100 and min(x.start for x in rows) == 0
    assert decontaminate.ORACLE
