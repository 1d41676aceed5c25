"""Benchmark decontamination by winnowing.

Both sides are cut into 5-word grams; in every run of 6 consecutive grams (10 words) the one of least hash, the last of
equals, is a fingerprint. Two texts that share 10 words share such a run, so they share its fingerprint: no long enough
shared span is missed. A fingerprint is extended to the 10-word windows that it stands for. Fingerprints of documents
that may be among those of the benchmark, with their windows, are joined to the benchmark's by fingerprint and
window; only windows of equal words are hits.

An item of fewer than 10 words (but at least one) is one window; grams of exactly its length are looked up for it, which
is winnowing with a run of one gram.

Neither side is collected. A bitmap of 2**SIEVE bits of the benchmark's fingerprints and one of its windows, 2 MB each
whatever its size, are made by partial aggregation and sent to all tasks; documents pass them once, and only windows
that are found in both leave their task, so documents themselves are not shuffled. A larger benchmark fills the bitmaps,
which lets more windows through to the join, where they end. A window that many documents hold is joined by broadcast (`shared.meet`).
Hits are found by text, so equal texts share them; only rows whose text may have hits are joined to them.

Defined cases: a null or empty text has no words, so no hit; a null item text or item_id is no item; repeated item_ids
count once; repeated rows each give their row; an empty table of documents gives no rows, one of items no hits; extra columns
are kept by `annotate` and may have any name. A text is held whole by its task, about 20 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm import shared
from tributary.llm.textcore import Words, as_bytes, grams, pieces

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
#: Bits of a sieve, as a power of two, and of one of its parts.
SIEVE, PART = 24, 1 << 15
PIECE = 1 << 20
KEY = ["one", "two"]


def marks(values: np.ndarray) -> np.ndarray:
    """Of each run of RUN consecutive grams, the position of the least, the last of equals."""
    size = len(values) - RUN + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    least, at = values[:size].copy(), np.zeros(size, np.int64)
    for k in range(1, RUN):
        now = values[k : k + size]
        lower = now <= least
        np.copyto(least, now, where=lower)
        at[lower] = k
    return np.arange(size) + at


def winnow(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The fingerprints: positions of the marks of runs that lie in one row."""
    return np.unique(marks(values)[inside])


class Sieve:
    """A bitmap of hashes; `may` says which hashes may be among them."""

    def __init__(self, hashes: DataFrame, column: str):
        place = F.shiftrightunsigned(column, 64 - SIEVE)
        rows = hashes.groupBy((place / PART).cast("int").alias("part")).agg(F.bitmap_construct_agg(place % PART).alias("bits"))
        self.bits = np.zeros((1 << SIEVE) // 8, np.uint8)
        for x in rows.collect():  # at most 2**SIEVE / PART rows of PART bits
            self.bits[x.part * PART // 8 :][: PART // 8] = np.frombuffer(x.bits, np.uint8)

    def may(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes.astype(np.uint64) >> np.uint64(64 - SIEVE)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def windows(words: Words, n: int, sieves: tuple[Sieve, Sieve] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, fingerprint, hash) of the windows of n words that lie in one row; with sieves only those that may be hits.

    With n = WINDOW the fingerprints are winnowed: windows are looked at only around one that the first sieve lets through."""
    values, inside = grams(words.hashes, words.row, n)
    if n < WINDOW:
        starts = np.flatnonzero(inside if sieves is None else inside & sieves[1].may(values))
        return starts, values[starts], values[starts]
    five, _ = grams(words.hashes, words.row, GRAM)
    at = marks(five)
    starts = np.flatnonzero(inside)
    if sieves is not None and len(starts):
        prints = np.unique(at[starts])
        known = np.zeros(len(five), bool)
        known[prints[sieves[0].may(five[prints])]] = True
        starts = starts[known[at[starts]]]
        starts = starts[sieves[1].may(values[starts])]
    return starts, five[at[starts]], values[starts]


_WINDOW = "mark long, window long, start long, n int, words binary"
_FOUND = pa.struct([("mark", pa.int64()), ("window", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to one row for each window of an item."""
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        for k, item in enumerate(batch.column(0).to_pylist()):
            words = Words(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
            n = min(WINDOW, len(words.starts))
            if not n:
                continue
            starts, mark, values = windows(words, n)
            text = pa.array([words.text(x, n) for x in starts.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(starts), pa.string()), pa.array(mark.view(np.int64)), pa.array(values.view(np.int64)), pa.array(np.full(len(starts), n, np.int32)), text], names=["item", "mark", "window", "n", "words"])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(mark, window, n, words, items): each window of the benchmark once, with the items that hold it."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    found = rows.mapInArrow(_item_windows, "item string, mark long, window long, n int, words binary")
    return shared.cut(found.groupBy("mark", "window", "n", "words").agg(F.array_sort(F.collect_set("item")).alias("items")))


def scan(docs: DataFrame, table: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(row, one, two, n_words, found): the kept columns as a struct, two hashes of the text, its number of words, and the windows
    that may be the benchmark's."""
    shared.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((Sieve(table, "mark"), Sieve(table, "window"), sorted(x.n for x in table.select("n").distinct().collect())))
    body = F.col(f"`{text}`")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    frame = docs.select(row.alias("row"), F.xxhash64(body).alias("one"), F.xxhash64(F.lit(1), body).alias("two"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *sieves, lengths = held.value
        for batch in batches:
            data, offsets = as_bytes(batch.column(3))
            counts, owner, columns = np.zeros(batch.num_rows, np.int64), [], [[] for _ in range(5)]
            for low, high in pieces(offsets, PIECE):
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                counts[low:high] = words.counts
                for n in lengths:
                    starts, mark, values = windows(words, n, tuple(sieves))
                    row = words.row[starts]
                    owner.append(low + row)
                    text = np.array([words.text(x, n) for x in starts.tolist()], object)
                    for held_, x in zip(columns, (mark.view(np.int64), values.view(np.int64), starts - words.first[row], np.full(len(starts), n, np.int32), text), strict=True):
                        held_.append(x)
            owners = np.concatenate([np.zeros(0, np.int64), *owner])
            order = np.argsort(owners, kind="stable")
            ends = np.searchsorted(owners[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            cells = [pa.array(np.concatenate(x)[order] if x else [], f.type) for x, f in zip(columns, _FOUND, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cells, fields=list(_FOUND)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts), found], names=["row", "one", "two", "n_words", "found"])

    schema = T.StructType([frame.schema["row"], T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("n_words", T.LongType())])
    schema.add("found", T.ArrayType(T._parse_datatype_string(f"struct<{_WINDOW.replace(' ', ':').replace(',:', ',')}>")))
    return frame.mapInArrow(run, schema)


def hits(scanned: DataFrame, table: DataFrame) -> DataFrame:
    """(one, two, ranges, items) of each text with a hit: its hit ranges of words as [start, end, start, end ...], and its items."""
    found = scanned.where(F.size("found") > 0).select(*KEY, "found").dropDuplicates(KEY).select(*KEY, F.explode("found").alias("x")).select(*KEY, "x.*")
    found = shared.cut(found)
    key = ["mark", "window"]
    hot = shared.hot_keys(found.groupBy(*key).agg(F.count("*").alias("n")), *key)
    met = shared.meet(found, table.select(*key, F.col("n").alias("length"), F.col("words").alias("same"), "items"), key, hot).where("n = length AND words = same")
    grouped = met.groupBy(*KEY).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"), F.collect_set("items").alias("items"))
    # spans in order, each joined to the last range if they touch
    ranges = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<long>"),
        lambda out, x: F.when((F.size(out) > 0) & (x["start"] <= F.element_at(out, -1)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(F.element_at(out, -1), x["end"])))).otherwise(F.concat(out, F.array(x["start"], x["end"]))),
    )
    return shared.cut(grouped.select(*KEY, ranges.alias("ranges"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")))


def _maybe(found: DataFrame):
    """A column that says whether a row's text (one) may be among those found."""
    held = found.sparkSession.sparkContext.broadcast(Sieve(found, "one"))

    @F.pandas_udf("boolean")
    def maybe(one: pd.Series) -> pd.Series:
        return pd.Series(held.value.may(one.to_numpy().view(np.uint64)))

    return maybe("one")


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, ranges, items): the kept columns (all, if none are named) as a struct, the text's words, hit word ranges, and
    items found."""
    table = benchmark_windows(benchmark, item, item_text)
    scanned = shared.cut(scan(docs, table, text, docs.columns if keep is None else keep))
    found = hits(scanned, table)
    # a row without a window that may be a hit has none, and meets nothing
    clean = scanned.where(F.size("found") == 0).select("row", "n_words", F.array().cast("array<long>").alias("ranges"), F.array().cast("array<string>").alias("items"))
    rest = scanned.where(F.size("found") > 0).select("row", "n_words", *KEY).join(found, KEY, "left")
    empty = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    return clean.unionByName(rest.select("row", "n_words", empty("ranges", "long"), empty("items", "string")))


def hit_words(ranges="ranges"):
    """How many words the ranges hold."""
    return F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no benchmark item occurs in, with all their columns; only those that may hold one are shuffled."""
    table = benchmark_windows(benchmark)
    found = hits(scan(docs, table, text, []), table).select(*KEY)
    body = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(body).alias("one"), F.xxhash64(F.lit(1), body).alias("two"))
    rows = rows.withColumn("maybe", _maybe(found))
    clean = rows.where("NOT maybe").select("row")
    return clean.unionByName(rows.where("maybe").join(found, KEY, "left_anti").select("row")).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: words, hit words, items, and whether it is contaminated."""
    found = annotate(docs, benchmark, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
found AS (SELECT r, i, d.n, item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)) d JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
