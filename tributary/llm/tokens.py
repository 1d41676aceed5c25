"""Token-ID output: whole texts to ids of a public tokenizer, in Simple-8b blocks, in ascending order of id.

Encoding. The tokenizer never joins across some places of a text: before a space between two characters that are not
white space, around a line feed between two such, and between a letter or digit and one of ``. , ; : ! ?``. Texts are cut
there in numpy, each distinct segment is encoded once by the tokenizers library (new ones that begin with their only space
many in one text, which it cuts there), and a bounded table keeps its ids by a 64-bit hash and its bytes, which are compared;
long segments are not kept. The ids of a text are those of its segments in
order. A text of more than ``LONG`` bytes goes through in spans that end at such places.

Files. Documents are range-partitioned and sorted by id; each partition writes Parquet rows, one for each block: shard,
block, ids before it in the shard, the documents' ids and counts, Simple-8b words and the word offset of each group of 128
ids. A block holds whole documents and ends once it has ``BLOCK_IDS`` ids. `read` gets blocks back and decodes them; the ids
before a shard are sums over shards, one number each.

Defined cases: a null or empty text has the end id only; a null doc_id sorts first; repeated doc_ids are ordered by a hash
of their text, and equal rows give equal entries one after another; an empty table gives no files with rows and no rows;
extra columns are not read, whatever their names; a text has no greatest length but that of an Arrow cell: its task holds its
bytes, ids and words, about 6 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import shared, simple8b
from tributary.llm.textcore import as_bytes, hashes, mix, pieces

U = np.uint64
END_ID = 2
BLOCK_IDS = 1 << 16
PIECE = 1 << 20
#: A text of more bytes is encoded in spans.
LONG = 4 << 20
#: Segments that are kept at most, and the longest of them in bytes; at the limit those seen once since the last time go.
KEPT, KEPT_BYTES = 1 << 19, 32
#: Bytes of input for each output shard, about.
SHARD_BYTES = 64 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_LATIN = np.zeros(256, bool)  # first bytes of two-byte characters among which there is no white space
_LATIN[0xC3:0xCA] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments that the tokenizer encodes apart; each row starts one."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        ends_solid, ends_letter = _SOLID[data], _ALNUM[data]  # of the character that ends at a byte
        second = _LATIN[data[:-1]]
        ends_solid[1:] |= second
        ends_letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins_solid = _SOLID[data] | _LATIN[data]
        inner = np.zeros(n + 1, bool)  # rows' starts: neighbours on the other side count for nothing
        inner[offsets] = True
        middle = slice(1, n - 1)
        lone = ends_solid[: n - 2] & begins_solid[2:] & ~inner[1 : n - 1] & ~inner[2:n]
        cut[middle] |= lone & ((data[middle] == 32) | (data[middle] == 10))
        cut[2:n] |= lone & (data[middle] == 10)
        cut[1:n] |= ends_letter[: n - 1] & _STOP[data[1:]] & ~inner[1:n]
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The first KEPT_BYTES bytes of each segment as 64-bit numbers, zeros after its end; one array for each place."""
    padded = np.concatenate([data, np.zeros(KEPT_BYTES + 8, np.uint8)])
    eights = np.ndarray((len(data) + KEPT_BYTES + 1,), "<u8", padded, 0, (1,))
    out = [eights[starts] & _MASKS[np.minimum(sizes, 8)]]
    for k in range(8, KEPT_BYTES, 8):
        more = np.flatnonzero(sizes > k)  # few segments are that long
        out.append(np.zeros(len(starts), np.uint64))
        out[-1][more] = eights[starts[more] + k] & _MASKS[np.minimum(sizes[more] - k, 8)]
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and which of them each key is; a sort that need not be stable is faster."""
    order = np.argsort(keys)
    held = keys[order]
    begins = np.concatenate([[True], held[1:] != held[:-1]])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(begins) - 1
    return held[begins], order[begins], which


_PLAIN = _SOLID | _LATIN
_PLAIN[0x80:0xC0] = True
#: Segments of one text that are encoded together.
JOINED = 64


class Encoder:
    """Texts to ids, as the tokenizers library gives them; keeps the ids of short segments, a bounded number of them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids of tokens that begin with a space
        self.spaced[[k for word, k in vocab.items() if word.startswith("\u0120")]] = True
        self.keys, self.starts, self.sizes, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.uint32)
        self.bytes = np.zeros((0, KEPT_BYTES // 8), np.uint64)
        self.seen = np.zeros(0, bool)  # which were met again

    def _forget(self) -> None:
        """Keeps what was met again; nothing if that is most of it."""
        keep = np.flatnonzero(self.seen)
        if len(keep) > KEPT // 2:
            keep = keep[:0]
        sizes = self.sizes[keep].astype(np.int64)
        ends = np.cumsum(sizes)
        self.pool = self.pool[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.keys, self.bytes, self.starts, self.sizes, self.seen = self.keys[keep], self.bytes[keep], (ends - sizes).astype(np.int32), self.sizes[keep], np.zeros(len(keep), bool)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _segment_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some segments one after another, and how many each has. Those that are a space and then only characters
        that are no white space are encoded many in one text: the tokenizer cuts at each space, and tokens that begin
        with one say where."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = ends - starts
        last = np.cumsum(sizes)
        held = data[np.repeat(starts - (last - sizes), sizes) + np.arange(last[-1])]
        strange = np.add.reduceat((~_PLAIN[held]).astype(np.int32), last - sizes)
        plain = (held[last - sizes] == 32) & (strange == 1) & (sizes > 1)
        rank = np.cumsum(plain) - 1
        apart = np.flatnonzero(~plain)
        together = held[np.repeat(plain, sizes)].tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes[plain])])
        stops = np.append(stops[:-1:JOINED], stops[-1]).tolist()
        texts = [together[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:], strict=True)]
        joined = np.array(list(chain.from_iterable(self.ids(texts))), np.uint32)
        begins = np.flatnonzero(self.spaced[joined])
        if len(begins) != rank[-1] + 1 or len(begins) and begins[0]:  # not a tokenizer of this kind
            plain, apart, joined, begins = np.zeros(n, bool), np.arange(n), joined[:0], begins[:0]
        lists = self.ids([held[a:b].tobytes().decode("utf-8", "replace") for a, b in zip((last - sizes)[apart].tolist(), last[apart].tolist(), strict=True)])
        counts = np.zeros(n, np.int64)
        counts[plain] = np.diff(np.append(begins, len(joined)))
        counts[apart] = np.fromiter(map(len, lists), np.int64, len(lists))
        out = np.empty(int(counts.sum()), np.uint32)
        mine = np.repeat(plain, counts)
        out[mine] = joined
        out[~mine] = np.fromiter(chain.from_iterable(lists), np.uint32, len(out) - len(joined))
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has."""
        if len(offsets) != 2 or len(data) <= LONG:
            return self._encode(data, offsets)
        out, low, size = [], 0, PIECE
        while low < len(data):
            part = data[low : low + size]
            cut = len(part) if low + size >= len(data) else int(segments(part, np.array([0, len(part)]))[-1])
            if not cut:  # one segment so far
                size *= 2
                continue
            out.append(self._encode(part[:cut], np.array([0, cut]))[0])
            low, size = low + cut, PIECE
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        starts = segments(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        long = lengths > KEPT_BYTES
        keys = self._hashes(data, starts, ends)
        packed = _packed(data, starts, lengths)
        keys[long] = np.flatnonzero(long).astype(np.uint64)  # apart from all others of this call
        packed[0][long] = keys[long]
        while True:
            kinds, first, which = _distinct(keys)
            like = first[which]
            strange = (lengths != lengths[like]) | (packed[0] != packed[0][like])  # other bytes of the same hash
            for k in range(1, len(packed)):
                more = np.flatnonzero((lengths > 8 * k) & ~long)
                strange[more] |= packed[k][more] != packed[k][like[more]]
            if not strange.any():
                break
            keys[strange] = mix(keys[strange] + U(1))
        single = long[first]
        held = np.stack([x[first] for x in packed], axis=1)
        at = np.minimum(np.searchsorted(self.keys, kinds), max(len(self.keys) - 1, 0))
        taken = self.keys[at] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
        known = taken & ~single
        known[known] = (self.bytes[at[known]] == held[known]).all(axis=1)
        new = np.flatnonzero(~known)
        fresh, sizes = self._segment_ids(data, starts[first[new]], ends[first[new]])
        pool = np.concatenate([self.pool, fresh])
        where, size = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        where[known], size[known] = self.starts[at[known]], self.sizes[at[known]]
        where[new], size[new] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        per = size[which]
        total = np.cumsum(per)
        out = pool[np.repeat(where[which] - (total - per), per) + np.arange(total[-1])]
        bounds = np.searchsorted(starts, offsets)
        sums = np.concatenate([[0], total])
        self.seen[at[known]] = True
        short = ~single[new] & ~taken[new]
        self._keep(kinds[new][short], held[new][short], sizes[short], fresh[np.repeat(short, sizes)])
        return out, sums[bounds[1:]] - sums[bounds[:-1]]

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return hashes(_VALUES, data, starts, ends)

    def _keep(self, kinds: np.ndarray, packed: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if len(self.keys) + len(kinds) > KEPT:
            self._forget()
            return
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, ids])
        into = np.searchsorted(self.keys, kinds)
        self.keys = np.insert(self.keys, into, kinds)
        self.bytes = np.insert(self.bytes, into, packed, axis=0)
        self.starts = np.insert(self.starts, into, starts.astype(np.int32))
        self.sizes = np.insert(self.sizes, into, sizes.astype(np.int16))
        self.seen = np.insert(self.seen, into, False)


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


_VALUES = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.uint64)

_SCHEMA = "shard int, block long, start long, doc_ids array<long>, counts array<long>, n_ids long, offsets array<int>, words binary"


def _writer(path: str, end_id: int):
    def row(block: list, shard: int, number: int, start: int) -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in block])
        words, offsets = simple8b.encode(ids)
        cell = [[shard], [number], [start], [[d for d, _ in block]], [[len(x) for _, x in block]], [len(ids)], [offsets.astype(np.int32)], [words.tobytes()]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(a, b) for a, b in zip(cell, kinds, strict=True)], names=["shard", "block", "start", "doc_ids", "counts", "n_ids", "offsets", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(path), TaskContext.get().partitionId()
        block, held, number, start = [], 0, 0, 0
        for batch in batches:
            names, (data, offsets) = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for low, high in pieces(offsets, PIECE):
                ids, counts = encoder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                at = 0
                for name, n in zip(names[low:high], counts.tolist(), strict=True):
                    block.append((name, np.append(ids[at : at + n], np.uint32(end_id))))
                    at += n
                    held += n + 1
                    if held >= BLOCK_IDS:
                        yield row(block, shard, number, start)
                        block, held, number, start = [], 0, number + 1, start + held
        if block:
            yield row(block, shard, number, start)

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, text: str = "text") -> None:
    """Writes the documents' ids to folder, in ascending order of doc_id."""
    spark = docs.sparkSession
    shared.tune(spark)
    bytes_in = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, bytes_in // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    rows = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(_writer(tokenizer or vocabulary(), end_id), _SCHEMA).write.parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start, doc_ids, counts, n_ids, offsets, words in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            ids = simple8b.decode(np.frombuffer(words, np.uint64), np.array(offsets, np.int64), n_ids).astype("<u4")
            ends = np.cumsum(counts)
            first = ends - counts
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([shard] * len(doc_ids), pa.int32()), pa.array(start + first), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    files = spark.read.parquet(folder)
    totals = sorted((x.shard, x.n) for x in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a number for each shard
    bases, before = [], 0
    for shard, n in totals:
        bases.append((shard, before))
        before += n
    base = spark.createDataFrame(bases, "shard int, base long")
    shared.tune(spark)
    rows = files.select("shard", "start", "doc_ids", "counts", "n_ids", "offsets", "words").mapInArrow(_reader, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def report(docs: DataFrame) -> DataFrame:
    folder = shared.scratch(docs.sparkSession, "tokens")
    write(docs, folder)
    return read(docs.sparkSession, folder)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"))
