"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased characters, per language, are summed over all labelled training documents
in Spark; their smoothed logarithms form a matrix of ``BUCKETS x languages``, which is broadcast. Its size is bound: the
number of buckets is a parameter, and more than ``MAX_LANGS`` languages are refused. A batch of texts is scored in numpy
from the non-zero counts of each text.

Defined cases: a null text, or one without any letter, is `und` with score 0; with no training rows every text is `und`;
ties go to the language that sorts first; repeated rows each give a row; null lang or doc_id never trains; an empty table gives
no rows; extra columns may have any name, as they travel in a struct; a long text is counted in parts of 512 K characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import shared
from tributary.llm.textcore import as_bytes, mix, pieces

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
MAX_LANGS = 512
SMOOTHING = 0.5
PIECE = 1 << 19
#: A pipeline's document stays if its language is known with at least this probability.
KEEP_SCORE = 0.5
LETTER = r"\p{L}"


def ngrams(texts: list[str], skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of lower-cased texts, but for those that end within the first `skip` characters."""
    joined = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(joined), dtype=np.int32), lengths)
    h, rows, out = np.zeros(len(points), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in ORDERS:
            inside = row[:size] == row[n - 1 :]
            inside[: max(0, skip - n + 1)] = False
            value = (mix(h + np.uint64(n)) >> np.uint64(50)).astype(np.int32)
            rows.append(row[:size][inside])
            out.append(value[inside])
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = as_bytes(column)
    for low, high in pieces(offsets, PIECE):
        yield low, high, [x or "" for x in column.slice(low, high - low).to_pylist()]


def counted(texts: list[str]) -> np.ndarray:
    """Two rows: row * BUCKETS + bucket of the n-grams of some texts, in order and each once, and how many there are; one long text
    goes through in parts that overlap, and no n-gram counts twice."""
    over = max(ORDERS) - 1
    if len(texts) == 1 and len(texts[0]) > PIECE:
        total = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(texts[0]), PIECE):
            _, bucket = ngrams([texts[0][max(0, at - over) : at + PIECE]], skip=min(at, over))
            total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        return np.stack([some, total[some]])
    row, bucket = ngrams(texts)
    return np.stack(np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n), summed over a task; at most MAX_LANGS x BUCKETS numbers are held."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for low, high, texts in _texts(batch.column(1)):
            for name in sorted(set(langs[low:high])):
                mine = [t for t, x in zip(texts, langs[low:high], strict=True) if x == name]
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                # a language's texts are one row; between two of them no n-gram counts
                if len(mine) == 1:
                    at, n = counted(mine)
                    sums[name][at] += n
                else:
                    sums[name] += np.bincount(ngrams(mine)[1], minlength=BUCKETS)
    for name, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])


class Model:
    """Languages and the log-probability matrix."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each text, and its posterior probability under equal priors."""
        logs = np.zeros((len(texts), len(self.langs)))
        step = 256
        for low in range(0, len(texts), step):
            at, n = counted(texts[low : low + step])
            if not len(at):
                continue
            weighed = self.matrix[at & (BUCKETS - 1)] * n[:, None]
            owner = at // BUCKETS
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            logs[low + owner[first]] = np.add.reduceat(weighed, first, axis=0)
        best = np.argmax(logs, axis=1)
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return best, 1.0 / odds.sum(axis=1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all the rows of docs that have a language and a text with a letter."""
    shared.tune(docs.sparkSession)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = shared.cut(sums)
    langs = [x.lang for x in sums.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs.sort()
    table = sums.toArrow()  # at most MAX_LANGS x BUCKETS rows
    counts = np.zeros((BUCKETS, len(langs)))
    code = {x: k for k, x in enumerate(langs)}
    counts[table["bucket"].to_numpy(), np.array([code[x] for x in table["lang"].to_pylist()], np.int64)] = table["n"].to_numpy()
    counts += SMOOTHING
    return Model(langs, np.log(counts / counts.sum(axis=0)))


def annotate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): the input's row as a struct and the prediction."""
    spark = docs.sparkSession
    shared.tune(spark)
    held = spark.sparkContext.broadcast(model)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").rlike(LETTER), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            row, letters = batch.column(0), np.array(batch.column(1).to_pylist(), bool)
            names, score = np.full(len(letters), "und", object), np.zeros(len(letters))
            if model.langs:
                for low, high, texts in _texts(row.field(row.type.get_field_index(text))):
                    best, p = model.scores(texts)
                    known = letters[low:high]
                    names[low:high] = np.where(known, np.array(model.langs, object)[best], "und")
                    score[low:high] = np.where(known, p, 0.0)
            yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return frame.mapInArrow(run, _schema(frame))


def _schema(frame: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([frame.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def learnable(docs: DataFrame) -> DataFrame:
    """The training part: rows whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(shared.crc_mod("doc_id", 4) != 2)


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    found = annotate(docs, fit(learnable(docs)))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= KEEP_SCORE)).select("row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = annotate(docs.select("doc_id", "text"), fit(learnable(docs)))
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", F.coalesce(shared.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
