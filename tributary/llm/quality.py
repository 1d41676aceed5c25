"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word (and run of punctuation) has a sparse random index vector: ``NONZERO`` signed ones among ``DIM`` places, from
its hash. The vector of a hashed word is the sum of the index vectors of its neighbours, up to ``REACH`` words away, over
all documents; integer sums are exact, so reruns agree. A document is the mean of its words' unit vectors, rare words
weighing more, with shares of word shapes and of repetitions beside it. A numpy network of one hidden layer learns the
labels; its logits are divided by a temperature that is fitted on rows it has not seen.

The word vectors are ``BUCKETS x DIM`` numbers, whatever the corpus. The network is fitted on at most ``TRAIN_ROWS``
labelled rows, those of the least hash of doc_id. The statistics cover all documents; labels come only from the learnable
part, and no id, language, source or label is an input of a score.

Defined cases: a null or empty text has the features of no words and is scored like any other; a label of null is no
label, several of one document count as their majority; with no labels the score is 0.5; repeated rows each give a row; an
empty table gives no rows; of labels of equal hash those of the least doc_id are taken; extra columns may have any name, as
they travel in a struct. A text of more than ``LONG`` bytes is pooled in spans, which neighbours do not reach across: about 3
bytes of memory for each of its bytes and 8 for each distinct word, and 100 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import shared
from tributary.llm.textcore import BYTE_VALUES, as_bytes, hashes, mix, pieces, runs, spans, tally

BUCKETS, DIM, NONZERO, REACH = 1 << 13, 32, 2, 2
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SHRINK = 32, 40, 256, 3e-3, 1e-3, 4
THRESHOLD = 0.3
PIECE = 1 << 18
#: A text of more bytes is pooled in spans of about a piece.
LONG = 1 << 20

_WORD = np.zeros(256, bool)
_MARK = np.zeros(256, bool)
_UPPER = np.zeros(256, bool)
_DIGIT = np.zeros(256, bool)
_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(33, 256):
    _UPPER[_b], _DIGIT[_b] = 65 <= _b <= 90, 48 <= _b <= 57
    _WORD[_b] = _UPPER[_b] or _DIGIT[_b] or 97 <= _b <= 122 or _b >= 128
    _MARK[_b] = not _WORD[_b] and _b != 127
_FOLD[65:91] += 32
SHAPES = 8
_KINDS = _WORD.astype(np.uint8) + 2 * _MARK.astype(np.uint8)


def _spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes and offsets of some rows, in spans if they are one long row."""
    if len(offsets) != 2 or len(data) <= LONG:
        yield data, offsets
        return
    for low, high in spans(data, _KINDS, PIECE):
        yield data[low:high], np.array([0, high - low])


class Tokens:
    """Words and punctuation runs of some rows, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        (a, b), (c, d) = runs(_WORD[data], offsets[:-1]), runs(_MARK[data], offsets[:-1])
        order = np.argsort(starts := np.concatenate([a, c]), kind="stable")
        self.starts, self.ends = starts[order], np.concatenate([b, d])[order]
        mark = np.concatenate([np.zeros(len(a), bool), np.ones(len(c), bool)])[order]
        self.hashes = hashes(BYTE_VALUES[_FOLD], data, self.starts, self.ends)
        bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(bounds)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        size = self.ends - self.starts
        upper, digit = tally(_UPPER, data, self.starts, self.ends), tally(_DIGIT, data, self.starts, self.ends)
        shape = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper == size, 2, 3)))
        shape = np.where(digit > 0, np.where(digit == size, 4, 5), shape)
        self.shape = np.where(mark, np.where(size > 1, 7, 6), shape)
        self.size = size
        self.bucket = (self.hashes >> np.uint64(51)).astype(np.int64)

    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and signs of the index vectors."""
        out = []
        for k in range(NONZERO):
            h = mix(self.hashes + np.uint64(k + 1))
            out.append(((h & np.uint64(DIM - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)))
        return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Iterator[Tokens]:
    for low, high in pieces(offsets, PIECE):
        for part in _spans(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]):
            yield Tokens(*part)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (bucket, n, v0 ...): what a task's words add to the vectors."""
    total, seen = np.zeros(BUCKETS * DIM, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = as_bytes(batch.column(0))
        for t in _tokens(data, offsets):
            seen += np.bincount(t.bucket, minlength=BUCKETS)
            index = t.index()
            for step in range(1, REACH + 1):
                near = t.row[step:] == t.row[:-step] if len(t.row) > step else np.zeros(0, bool)
                if not near.any():
                    continue
                for place, sign in index:
                    for at, by in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                        key = t.bucket[at][near] * DIM + place[by][near]
                        up = sign[by][near] > 0
                        total += np.bincount(key[up], minlength=len(total)) - np.bincount(key[~up], minlength=len(total))
    at = np.flatnonzero(seen)
    columns = total.reshape(BUCKETS, DIM)[at]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at]), *[pa.array(columns[:, k].astype(np.int32)) for k in range(DIM)]], names=["bucket", "n", *[f"v{k}" for k in range(DIM)]])


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all buckets, and the weight of each, from all documents."""
    shared.tune(docs.sparkSession)
    names = [f"v{k}" for k in range(DIM)]
    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").mapInArrow(_sums, "bucket int, n long, " + ", ".join(f"{x} int" for x in names))
    table = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toArrow()  # at most BUCKETS rows
    vectors, weight = np.zeros((BUCKETS, DIM)), np.ones(BUCKETS)
    if len(table):
        at, n = table["bucket"].to_numpy(), table["n"].to_numpy()
        vectors[at] = np.stack([table[x].to_numpy() for x in names], axis=1)
        share = n / n.sum()
        weight[at] = 1e-3 / (1e-3 + share)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors, weight


WIDTH = DIM + SHAPES + 5


class Pool:
    """Sums over the words of some rows, to which spans of them are added."""

    def __init__(self, rows: int):
        self.vectors, self.shapes = np.zeros((rows, DIM)), np.zeros((rows, SHAPES))
        self.weight, self.words, self.bytes, self.distinct, self.again = (np.zeros(rows) for _ in range(5))
        self.last: np.uint64 | None = None

    def add(self, t: Tokens, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Adds a span; returns the hashes of its distinct words by row."""
        n = len(t.counts)
        first = np.flatnonzero(np.diff(t.row, prepend=-1))
        w = weight[t.bucket]
        self.vectors[t.counts > 0] += np.add.reduceat(vectors[t.bucket] * w[:, None], first, axis=0)
        self.weight += np.bincount(t.row, w, n)
        self.shapes += np.bincount(t.row * SHAPES + t.shape, minlength=n * SHAPES).reshape(n, SHAPES)
        self.words += t.counts
        self.bytes += np.bincount(t.row, t.size, n)
        again = np.zeros(len(t.row), bool)
        again[1:] = (t.hashes[1:] == t.hashes[:-1]) & (t.row[1:] == t.row[:-1])
        again[0] = self.last is not None and self.last == t.hashes[0]  # the span before ended with this word
        self.last = t.hashes[-1]
        self.again += np.bincount(t.row[again], minlength=n)
        kinds, at = np.unique(t.hashes ^ mix(t.row.astype(np.uint64) + np.uint64(1)), return_index=True)
        self.distinct += np.bincount(t.row[at], minlength=n)
        return kinds

    def numbers(self) -> np.ndarray:
        """WIDTH numbers for each row; zeros for no words."""
        total = np.maximum(self.words, 1)
        unlike = self.distinct / total
        mean = self.vectors / np.maximum(self.weight, 1e-9)[:, None]
        many = np.log1p(self.words)
        return np.column_stack([mean, self.shapes / total[:, None], many, unlike, self.again / total, np.log1p(self.bytes / total), unlike * many])


def features(column: pa.Array, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers for each text."""
    data, offsets = as_bytes(column)
    out = np.zeros((len(offsets) - 1, WIDTH))
    for low, high in pieces(offsets, PIECE):
        pool, kinds = Pool(high - low), np.zeros(0, np.uint64)
        for part in _spans(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]):
            t = Tokens(*part)
            if not len(t.row):
                continue
            more = pool.add(t, vectors, weight)
            if len(kinds):  # another span of one long text
                more = np.union1d(kinds, more)
                pool.distinct[0] = len(more)
            kinds = more
        out[low:high] = pool.numbers()
    return out


class Network:
    """Standardised inputs, a hidden layer of tanh, a logit, and the temperature that divides it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trained = len(y) > 1 and 0 < y.mean() < 1
        self.constant = float(y.mean()) if len(y) else 0.5
        if not self.trained:
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        order = rng.permutation(len(y))
        held = order[: len(y) // 5] if len(y) >= 50 else order
        used = order[len(y) // 5 :] if len(y) >= 50 else order
        z = self._standard(x)
        self.p = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for low in range(0, len(used), BATCH):
                k = used[low : low + BATCH]
                hidden = np.tanh(z[k] @ self.p[0] + self.p[1])
                error = (_sigmoid(hidden @ self.p[2] + self.p[3]) - y[k]) / len(k)
                back = np.outer(error, self.p[2]) * (1 - hidden**2)
                slopes = [z[k].T @ back + DECAY * self.p[0], back.sum(axis=0), hidden.T @ error + DECAY * self.p[2], np.array([error.sum()])]
                step += 1
                for a, g, mm, vv in zip(self.p, slopes, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        logit, truth = self._logit(z[held]), y[held]
        loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(truth > 0.5, 1, -1) * logit / t)))
        self.temperature = min(np.geomspace(1 / 8, 8, 61), key=loss)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        """Inputs by mean and deviation; those of few words are drawn to the mean, as their shares say little."""
        words = np.expm1(x[:, DIM + SHAPES])
        return np.clip((x - self.mean) / self.scale, -8, 8) * np.sqrt(words / (words + SHRINK))[:, None]

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.constant)
        return _sigmoid(self._logit(self._standard(x)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learnable(labels: DataFrame, column: str = "quality") -> DataFrame:
    """(doc_id, label) of the part that labels may be learned from, one row for each document."""
    rows = labels.where(F.col(column).isNotNull() & (shared.crc_mod("doc_id", 5) != 0))
    return rows.groupBy("doc_id").agg((F.avg(F.col(column)) >= 0.5).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text"):
    """Word vectors of all documents, and a network fitted on at most train_rows of the labels (doc_id, label)."""
    vectors, weight = word_vectors(docs, text)
    held = docs.sparkSession.sparkContext.broadcast((vectors, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2), *held.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    # first about twice as many by hash, so that what meets in one place does not grow with the labels
    share = int((1 << 30) * min(1.0, 2 * train_rows / max(1, labels.count())))
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")  # at most train_rows rows are broadcast
    found = rows.mapInArrow(run, "doc_id long, label int, x array<float>").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("x").alias("x"))
    table = found.toArrow().sort_by("doc_id")
    x = np.array(table["x"].combine_chunks().flatten(), np.float64).reshape(-1, WIDTH) if len(table) else np.zeros((0, WIDTH))
    return vectors, weight, Network(x, table["label"].to_numpy().astype(float))


def annotate(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """(row, quality_score): the input's row as a struct, and the probability that it is of quality."""
    from pyspark.sql import types as T

    shared.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weight, network = held.value
        for batch in batches:
            row = batch.column(0)
            score = network.scores(features(row.field(row.type.get_field_index(text)), vectors, weight))
            yield pa.RecordBatch.from_arrays([row, pa.array(score)], names=["row", "quality_score"])

    return frame.mapInArrow(run, T.StructType([frame.schema["row"], T.StructField("quality_score", T.DoubleType())]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(shared.table(spark, sf_dir, "labels")))
    scored = annotate(docs, model).select("row.doc_id", F.col("quality_score").alias("score"))
    return scored.select("doc_id", F.coalesce(shared.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
