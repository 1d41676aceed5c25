"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are five words (a text of fewer words is one shingle of all). A shingle's weight is (1 + ln tf) times an idf,
1 + IDF_SPAN * ln(N / df) / ln(1 / RARE), where df counts each document once, over all N documents that have a text, and is
at least RARE * N: what fewer than one document in a thousand hold weighs most, whatever the corpus' size. Frequencies are
counted in ``DF_BUCKETS`` hashed buckets, a table of fixed size that is broadcast. The median load, that of rare shingles, is
taken off; its spread is the root of the load, which falls below RARE * N as N grows. The span is small on purpose: with an
unbounded idf one changed word in a widely copied text would weigh as much as all the rest, and copies of it would be lost.

1. Documents of equal words (a 128-bit digest) are one text from here on; the least doc_id stands for it.
2. Each text draws ``BANDS * ROWS`` consistent weighted samples; equal with probability of the weighted Jaccard similarity.
   A band is a hash of ROWS samples. At similarity 0.8 a pair misses all bands with probability 0.0001.
3. A band of at most ``ALL_PAIRS`` texts gives all its pairs. In a larger one each text meets the band's leaders: the least
   member, the greatest by an order salted by band, and the middle, whose own bands are the largest in sum: copies of one
   original each differ from it where they were edited, and from each other where either was. That is three pairs a
   member, found by partial minima and maxima; no large group is ever gathered.
4. A pair whose samples agree too little to be at the threshold (less than ``SIEVE`` of them) is dropped; the rest are
   verified on all their shingles: a weighted Jaccard similarity of 0.8 or more is a link.
5. Members of a larger band whom these links leave in different components are compared each with each, in blocks of
   ``CHUNK`` texts, and verified likewise. Only pairs that a class joins already are left out; of a band's largest component
   no member is compared with another. What is left grows with the square of the texts that share bands without links.
6. Classes are connected components of the links, by least label, with checkpoints; nothing of them is collected.

The ``shared.HOT_SHARE`` keys of the most rows (a band, a label, a leader, a digest of copies) are joined by broadcast of
their one row each, if they hold many; so a key that is shuffled holds less than one row in HOT_SHARE.

Defined cases: a text without words (null, empty, marks only) is a class of its own row; equal rows are one class; a null
doc_id can be a member, and stands for a class only if all its ids are null; ties go to the least doc_id; an empty table has
no classes; extra columns may have any name, and `keep_one` keeps them. A text of more than ``LONG`` bytes is read in spans:
about 6 bytes of memory for each of its bytes in words of usual length, 16 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import shared
from tributary.llm.textcore import Words, as_bytes, grams, mix, pieces, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 18, 4
SAMPLES = BANDS * ROWS
DF_BUCKETS = 1 << 18
IDF_SPAN = 0.2
#: Shingles that fewer than this share of all documents hold have the greatest idf.
RARE = 1e-3
#: A pair at similarity 0.8 agrees in less than this share of the samples with probability below 1e-6.
SIEVE = 0.5
#: Bands of at most so many texts give all their pairs; larger ones are led.
ALL_PAIRS = 16
#: Pairs of one text that one task verifies, about.
GROUP = 256
#: Texts and shingles of a block's held side, and texts of its other side, on average.
CHUNK, CHUNK_SHINGLES, STREAM = 512, 1 << 18, 2048
PIECE = 1 << 20
#: A text of more bytes is read in spans.
LONG = 4 << 20
U = np.uint64
_SALTS = (U(0x9FB21C651E98DF25), U(0xE7037ED1A0B428DB))


def _short(hashes: np.ndarray) -> np.uint64:
    """The one shingle of fewer than SHINGLE words."""
    h = 1469598103934665603
    for x in hashes.tolist():
        h = (h * 0xD1342543DE82EF95 + x) % (1 << 64)
    return mix(np.array([h], np.uint64))[0]


def _long_shingles(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `shingles`, of one long text."""
    hashes = word_hashes(data)
    digests = np.zeros((1, 2), np.uint64)
    if len(hashes):
        for k, salt in enumerate(_SALTS):
            total = 0
            for low in range(0, len(hashes), PIECE):
                place = np.arange(low, min(len(hashes), low + PIECE), dtype=np.uint64)
                total += int(mix(hashes[low : low + PIECE] ^ mix(place * salt + U(k + 1))).sum(dtype=np.uint64))
            digests[0, k] = mix(np.array([(total + len(hashes)) % (1 << 64)], np.uint64))[0]
    if 0 < len(hashes) < SHINGLE:
        return np.zeros(1, np.int64), np.array([_short(hashes)]), np.ones(1, np.int64), digests
    value, _ = grams(hashes, np.zeros(len(hashes), np.int8), SHINGLE)
    del hashes
    value.sort()
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return np.zeros(len(first), np.int64), value[first], np.diff(np.append(first, len(value))), digests


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, distinct shingle hashes in order within a row, how often each occurs, and a 128-bit digest of each row's words."""
    if len(offsets) == 2 and len(data) > LONG:
        return _long_shingles(data)
    words = Words(data, offsets)
    n = len(words.counts)
    values, inside = grams(words.hashes, words.row, SHINGLE)
    row, value = words.row[: len(values)][inside], values[inside]
    bounds = np.searchsorted(row, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[a:b].sort()
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        extra = np.array([_short(words.hashes[words.first[r] : words.first[r] + words.counts[r]]) for r in short.tolist()], np.uint64)
        into = bounds[short]
        row, value = np.insert(row, into, short), np.insert(value, into, extra)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(row)))
    digests = np.zeros((n, 2), np.uint64)
    if len(words.row):
        place = (np.arange(len(words.row)) - words.first[words.row]).astype(np.uint64)
        starts = np.flatnonzero(np.diff(words.row, prepend=-1))
        some = words.row[starts]
        for k, salt in enumerate(_SALTS):
            digests[some, k] = mix(np.add.reduceat(mix(words.hashes ^ mix(place * salt + U(k + 1))), starts) + words.counts[some].astype(np.uint64))
    return row[first], value[first], counts, digests


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> U(64 - DF_BUCKETS.bit_length() + 1)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (bucket, n): in how many of the task's documents the shingles of a bucket are, in sum."""
    total = np.zeros(DF_BUCKETS, np.int64)
    for batch in batches:
        data, offsets = as_bytes(batch.column(0))
        for low, high in pieces(offsets, PIECE):
            _, value, _, _ = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            total += np.bincount(_bucket(value), minlength=DF_BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The idf of each bucket, in [1, 1 + IDF_SPAN]; DF_BUCKETS numbers whatever the corpus."""
    shared.tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    total = max(1, rows.count())
    sums = rows.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most DF_BUCKETS rows
    n = np.zeros(DF_BUCKETS)
    n[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    df = np.clip(n - np.median(n), max(1.0, RARE * total), total)
    return (1 + IDF_SPAN * np.log(total / df) / np.log(1 / RARE)).astype(np.float32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1): r, and ln c; both are drawn by 16 bits of a hash."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(len(u), 1.7)
    low, high = np.zeros(len(u)), np.full(len(u), 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - np.exp(-x) * (1 + x) < u
        low, high = np.where(under, x, low), np.where(under, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_GAMMA, _LOG_GAMMA = _tables()
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_CHUNK = 1 << 14


def samples(value: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit samples of each row; first: where rows begin among the shingles."""
    out = np.full((len(first), SAMPLES), 0xFFFFFFFF, np.uint64)
    if not len(value):
        return out.astype(np.uint32)
    log_weight = np.log(weight).astype(np.float32)
    row = np.zeros(len(value), np.int64)
    row[first[1:]] = 1
    row = np.cumsum(row)
    best = np.full((len(first), SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(value), _CHUNK):
        part = slice(low, min(len(value), low + _CHUNK))
        mine, rows, logs = value[part], row[part], log_weight[part]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        owners = rows[starts]
        for k in range(SAMPLES):
            h = mine ^ _SEEDS[k]
            h *= U(0xBF58476D1CE4E5B9)
            h ^= h >> U(32)
            h *= U(0x94D049BB133111EB)
            h ^= h >> U(29)
            parts = h.view(np.uint16).reshape(-1, 4)
            r = _GAMMA[parts[:, 1]]
            beta = parts[:, 2].astype(np.float32)
            beta *= np.float32(1 / 65536)
            t = np.floor(logs / r + beta)
            a = _LOG_GAMMA[parts[:, 3]] - r * (t - beta + np.float32(1))
            # an order-preserving integer of a above, the sample's name below
            bits = a.view(np.int32)
            key = ((bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)).astype(np.uint64) << U(32)
            key |= (h >> U(16) ^ (t.astype(np.int64).astype(np.uint64) * U(0x9E3779B1))) & U(0xFFFFFFFF)
            least = np.minimum.reduceat(key, starts)
            best[owners, k] = np.minimum(best[owners, k], least)
    return (best & U(0xFFFFFFFF)).astype(np.uint32)


def _signer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            for low, high in pieces(offsets, PIECE):
                row, value, counts, digests = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                first = np.flatnonzero(np.diff(row, prepend=-1))
                found = samples(value, (1 + np.log(counts)) * idf[_bucket(value)], first)
                keys, signs = [None] * (high - low), [None] * (high - low)
                sizes = np.bincount(row, minlength=high - low)
                for k, r in enumerate(row[first].tolist()):
                    keys[r], signs[r] = digests[r].tobytes(), found[k].tobytes()
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "content", "digest", "samples", "size"])

    return run


def texts(docs: DataFrame, idf: np.ndarray, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, content, digest) of all rows, digest null without words; and nodes (node, doc_id, digest, samples,
    size, copies), one for each distinct text; size is its number of distinct shingles. content is a hash of the text as it is."""
    held = docs.sparkSession.sparkContext.broadcast(idf)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("content"), F.col(f"`{text}`").alias("text"))
    signed = shared.cut(rows.mapInArrow(_signer(held), "doc_id long, content long, digest binary, samples binary, size long"))
    nodes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("samples").alias("samples"), F.min("size").alias("size"), F.count("*").alias("copies"))
    nodes = shared.cut(nodes.select(F.monotonically_increasing_id().alias("node"), "doc_id", "digest", "samples", "size", "copies"))
    return signed.select("doc_id", "content", "digest"), nodes


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
        band = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
        for k in range(ROWS):
            band = mix(band * U(0xD1342543DE82EF95) + found[:, :, k])
        yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n))], names=["band", "node", "place"])


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(low, high): pairs of small bands and with leaders of larger ones, of whose samples at least SIEVE are equal; and
    (band, place, node): the members of larger bands."""
    bands = nodes.select("node", "samples").mapInArrow(_banded, "band long, node long, place int")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max(F.col("node").bitwiseXOR(F.col("band"))).alias("x"), F.max("node").alias("z"))
    sizes = shared.cut(sizes.where("a < z").select("band", "n", "a", F.col("x").bitwiseXOR(F.col("band")).alias("b")))
    hot = shared.hot_keys(sizes, "band")
    met = shared.cut(shared.meet(bands, sizes, "band", hot))
    # small bands: all their pairs, at most ALL_PAIRS * (ALL_PAIRS - 1) / 2
    groups = met.where(F.col("n") <= ALL_PAIRS).groupBy("band").agg(F.sort_array(F.collect_set("node")).alias("g"))
    inner = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.lit(ALL_PAIRS)), lambda y: F.struct(x.alias("low"), y.alias("high")))))
    pairs = groups.select(F.explode(inner).alias("p")).select("p.low", "p.high")
    # larger ones: each member with the leaders; the third is the member whose own bands are the largest in sum
    large = met.where(F.col("n") > ALL_PAIRS)
    members = large.select("band", "place", "node")
    score = met.groupBy("node").agg(F.sum("n").alias("score"))
    large = shared.cut(large.join(score, "node"))
    middle = shared.cut(large.groupBy("band").agg(F.max(F.struct("score", "node")).alias("m")).select("band", F.col("m.node").alias("c")))
    stars = shared.cut(shared.meet(large, middle, "band", hot).select("node", "a", "b", "c").distinct())
    for leader in ("a", "b", "c"):
        pairs = pairs.unionByName(stars.where(f"node <> {leader}").select(F.least("node", leader).alias("low"), F.greatest("node", leader).alias("high")))
    pairs = shared.cut(pairs.distinct())
    signs = nodes.select("node", "samples")
    # hot keys of both sides before any join: counted on the joined pairs, they would run the first join once more
    hot = {side: shared.hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), side) for side in ("low", "high")}
    for side, name in (("low", "one"), ("high", "two")):
        pairs = shared.meet(pairs, signs.toDF(side, name), side, hot[side])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, SAMPLES) for k in (2, 3))
            same = (one == two).mean(axis=1)
            keep = np.flatnonzero(same >= SIEVE)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["low", "high"])

    return shared.cut(pairs.select("low", "high", "one", "two").mapInArrow(agree, "low long, high long")), members


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingles with weights."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    least = np.minimum(a[1][x], b[1][y]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def _verifier(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (group, salt, role, node): a leader, then its members."""
        idf = held.value
        group, leader, last = None, None, None
        for batch in batches:
            column = batch.schema.get_field_index
            data, offsets = as_bytes(batch.column(column("text")))
            heads = list(zip(*[batch.column(column(x)).to_pylist() for x in ("low", "salt", "role", "node")], batch.column(column("digest")).to_pylist(), strict=True))
            links: list[tuple[int, int, float]] = []
            for low, high in pieces(offsets, PIECE):
                row, value, counts, digests = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                weight = (1 + np.log(counts)) * idf[_bucket(value)]
                bounds = np.searchsorted(row, np.arange(high - low + 1))
                for k in range(high - low):
                    first, salt, role, node, digest = heads[low + k]
                    if digests[k].tobytes() != digest:
                        continue  # another text under the same doc_id
                    if (first, salt, role, node) == last:
                        continue  # a repeated row
                    last = (first, salt, role, node)
                    mine = (value[bounds[k] : bounds[k + 1]], weight[bounds[k] : bounds[k + 1]])
                    if role == 0:
                        group, leader = (first, salt), mine
                    elif group == (first, salt):
                        found = similarity(leader, mine)
                        if found >= THRESHOLD:
                            links.append((first, node, found))
            a, b, c = zip(*links, strict=True) if links else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["low", "high", "similarity"])

    return run


class _Block:
    """Texts that others are compared with: (node, label, samples, shingles, weights) of each."""

    def __init__(self, held: list[tuple]):
        self.nodes, self.labels = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        self.samples = np.stack([x[2] for x in held])
        self.sizes = np.array([len(x[3]) for x in held])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.names, self.ids = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
        self.weights = np.concatenate([x[4] for x in held])
        self.totals = np.add.reduceat(self.weights, self.firsts)
        self.other = np.zeros(len(self.names))

    def links(self, place: int, alone: bool, node: int, label: int, signs: np.ndarray, value: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
        """Links of a text to those held of other labels; a pair is looked at in its first common band only, and once if both are held."""
        same = self.samples == signs
        first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        wanted = (same.mean(axis=1) >= SIEVE) & (self.labels != label) & (first == place)
        pick = np.flatnonzero(wanted if alone else wanted & (self.nodes < node))
        if not len(pick):
            return []
        at = np.minimum(np.searchsorted(self.names, value), len(self.names) - 1)
        known = self.names[at] == value
        self.other[at[known]] = weight[known]
        sizes = self.sizes[pick]
        starts = np.cumsum(sizes) - sizes
        which = np.repeat(self.firsts[pick] - starts, sizes) + np.arange(sizes.sum())
        theirs = self.other[self.ids[which]]
        self.other[at[known]] = 0
        least = np.add.reduceat(np.minimum(theirs, self.weights[which]), starts)
        found = least / (self.totals[pick] + weight.sum() - least)
        near = found >= THRESHOLD
        return [(min(node, x), max(node, x), y) for x, y in zip(self.nodes[pick[near]].tolist(), found[near].tolist(), strict=True)]


def _crosser(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (band, chunk, part, role, node): the texts of a block, then those to compare with all of them."""
        idf = held.value
        group, last, members, block = None, None, [], None
        for batch in batches:
            column = batch.schema.get_field_index
            data, offsets = as_bytes(batch.column(column("text")))
            signs = np.frombuffer(b"".join(batch.column(column("samples")).to_pylist()), np.uint32).reshape(-1, SAMPLES)
            heads = list(zip(*[batch.column(column(x)).to_pylist() for x in ("band", "chunk", "part", "role", "node", "place", "alone", "label", "digest")], strict=True))
            links: list[tuple[int, int, float]] = []
            for low, high in pieces(offsets, PIECE):
                row, value, counts, digests = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                weight = (1 + np.log(counts)) * idf[_bucket(value)]
                bounds = np.searchsorted(row, np.arange(high - low + 1))
                for k in range(high - low):
                    *key, role, node, place, alone, label, digest = heads[low + k]
                    if digests[k].tobytes() != digest:
                        continue  # another text under the same doc_id
                    if (key, role, node) == last:
                        continue  # a repeated row
                    last = (key, role, node)
                    if group != key:
                        group, members, block = key, [], None
                    part = slice(bounds[k], bounds[k + 1])
                    if role == 0:
                        members.append((node, label, signs[low + k].copy(), value[part].copy(), weight[part].copy()))
                    elif members:
                        block = block or _Block(members)
                        links += block.links(place, alone, node, label, signs[low + k], value[part], weight[part])
            a, b, c = zip(*links, strict=True) if links else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["low", "high", "similarity"])

    return run


def _texts_of(docs: DataFrame, ends: DataFrame, text: str) -> DataFrame:
    """Rows of ends (of, ...) with the texts of that doc_id."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    return wanted.join(ends, F.col("doc_id").eqNullSafe(F.col("of")))


def crossed(docs: DataFrame, nodes: DataFrame, idf, members: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(low, high, similarity): all links between members (band, place, node) of one band that the links found so far leave in
    different components. Members outside the band's largest component are held, CHUNK to a block; all members meet them."""
    labels = members.join(components(found), "node", "left").join(nodes.select("node", "size"), "node")
    labels = shared.cut(labels.select("band", "place", "node", "size", F.coalesce("label", "node").alias("label")))
    counts = labels.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    bands = counts.groupBy("band").agg(F.max(F.struct("n", "size", "label")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > main.n")
    chunks = F.greatest(F.ceil((F.col("n") - F.col("main.n")) / CHUNK), F.ceil((F.col("size") - F.col("main.size")) / CHUNK_SHINGLES)).cast("int")
    bands = shared.cut(bands.select("band", "n", F.col("main.label").alias("main"), chunks.alias("chunks"), F.ceil(F.col("n") / STREAM).cast("int").alias("parts")))
    rows = shared.cut(shared.meet(labels, bands, "band", shared.hot_keys(bands, "band")).withColumn("alone", F.col("label") == F.col("main")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["band", "place", "node", "label", "alone"]
    kept = rows.where("NOT alone").select(*names, F.lit(0).alias("role"), F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), every("parts").alias("part"))
    met = rows.select(*names, F.lit(1).alias("role"), every("chunks").alias("chunk"), F.pmod(F.hash("node"), "parts").cast("int").alias("part"))
    ends = kept.unionByName(met).join(nodes.select("node", F.col("doc_id").alias("of"), "digest", "samples"), "node")
    held = docs.sparkSession.sparkContext.broadcast(idf)
    rows = _texts_of(docs, ends, text).select(*names, "role", "chunk", "part", "digest", "samples", "text")
    rows = rows.repartition("band", "chunk", "part").sortWithinPartitions("band", "chunk", "part", "role", "node")
    return shared.cut(rows.mapInArrow(_crosser(held), "low long, high long, similarity double"))


def links(docs: DataFrame, nodes: DataFrame, idf, text: str = "text") -> DataFrame:
    """(low, high, similarity): the candidates that all their shingles confirm, and further links within larger bands."""
    met, members = candidates(nodes)
    degree = shared.cut(met.groupBy("low").agg(F.count("*").alias("n")))
    pairs = shared.meet(met, degree, "low", shared.hot_keys(degree, "low"))
    pairs = shared.cut(pairs.select("low", "high", F.pmod(F.xxhash64("high"), F.ceil(F.col("n") / GROUP)).alias("salt")))
    ends = pairs.select("low", "salt", F.lit(1).alias("role"), F.col("high").alias("node")).unionByName(pairs.select("low", "salt").distinct().select("low", "salt", F.lit(0).alias("role"), F.col("low").alias("node")))
    ends = shared.cut(ends.join(nodes.select("node", F.col("doc_id").alias("of"), "digest"), "node"))
    held = docs.sparkSession.sparkContext.broadcast(idf)
    rows = _texts_of(docs, ends, text).select("low", "salt", "role", "node", "digest", "text")
    rows = rows.repartition("low", "salt").sortWithinPartitions("low", "salt", "role", "node")
    found = shared.cut(rows.mapInArrow(_verifier(held), "low long, high long, similarity double"))
    return found.unionByName(crossed(docs, nodes, idf, members, found, text))


def components(found: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """(node, label) of all nodes with a link: the least node of the component."""
    edges = shared.cut(found.select(F.col(low).alias("u"), F.col(high).alias("v")).unionByName(found.select(F.col(high).alias("u"), F.col(low).alias("v"))))
    labels = shared.cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"))
    ends = shared.hot_keys(edges.groupBy("v").agg(F.count("*").alias("n")), "v")
    while True:
        near = shared.meet(edges, labels.toDF("v", "far"), "v", ends).groupBy("u").agg(F.min("far").alias("near")).withColumnRenamed("u", "node")
        hooked = shared.cut(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        large = shared.hot_keys(hooked.groupBy("label").agg(F.count("*").alias("n")), "label")
        jumped = shared.meet(hooked, hooked.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", large)
        now = shared.cut(jumped.select("node", "was", F.least("label", "root").alias("label")))
        if now.where("label <> was").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, content, digest, class_id): one row for each document; class_id is the least doc_id of its class, the
    document's own if it has no words."""
    shared.tune(docs.sparkSession)
    idf = idf_table(docs, text)
    members, nodes = texts(docs, idf, text)
    labels = components(links(docs, nodes, idf, text))
    named = shared.cut(labels.join(nodes.select("node", "doc_id", "digest"), "node"))
    heads = shared.cut(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")))
    linked = shared.meet(named, heads, "label", shared.hot_keys(heads, "label")).select("digest", "class_id")
    alone = nodes.join(labels, "node", "left_anti").select("digest", F.col("doc_id").alias("class_id"))
    table = shared.cut(linked.unionByName(alone))
    hot = shared.hot_keys(nodes.select("digest", F.col("copies").alias("n")), "digest")
    return shared.meet(members, table, "digest", hot, "left").select("doc_id", "content", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each class, that of the least doc_id, with all its columns; documents without words all stay."""
    found = shared.cut(classes(docs, text).where("digest IS NOT NULL"))
    # of the class's least doc_id one row stays; the same id may stand for several texts, and rows may be repeated
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("content").alias("content"), F.count("*").alias("n"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    drop = found.where(~kept).select("doc_id", "content").distinct().withColumn("once", F.lit(False))
    several = first.where("n > 1").select(F.col("class_id").alias("doc_id"))
    again = found.where(kept).join(several, found["doc_id"].eqNullSafe(several["doc_id"]), "left_semi").groupBy("doc_id").agg(F.collect_set("content").alias("contents"))
    once = again.select("doc_id", F.explode("contents").alias("content")).withColumn("once", F.lit(True))
    verdict = shared.cut(drop.unionByName(once).toDF("_of", "_content", "_once"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_key"))
    rows = rows.join(verdict, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_content")), "left")
    stay = rows.where("_once IS NULL").select("row")
    one = rows.where("_once").dropDuplicates(["_id", "_key"]).select("row")
    return stay.unionByName(one).select("row.*")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_first"))
