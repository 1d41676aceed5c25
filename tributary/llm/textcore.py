"""Vectorised work on the UTF-8 bytes of whole Arrow batches: words, hashes, and ranges per row.

Nothing here loops over rows or words in Python. A hash of a byte range is a difference of two prefix sums of
``table[byte] * base**position`` (mod 2**64), divided by ``base**start``; as the base is odd, that division is a product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = 1 << 14


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW_POW, _LOW_INV = _powers(_BASE, _LOW), _powers(_INVERSE, _LOW)
#: A random 64-bit value for each byte, fixed by the seed.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its rows' offsets in them (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def runs(member: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes; a run ends at each row start."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[row_starts[row_starts <= n]] = True
    first[n] = True
    begin = member.copy()
    begin[1:] &= ~member[:-1] | first[1:n]
    end = member.copy()
    end[:-1] &= ~member[1:] | first[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    n = len(values)
    out = np.empty(n + 1, np.uint64)
    out[0] = 0
    rows = -(-n // _LOW)
    high = _powers(pow(_BASE, _LOW, 1 << 64), max(rows, 1))
    body = out[1:]
    for k in range(rows):
        part = slice(k * _LOW, min(n, (k + 1) * _LOW))
        np.multiply(values[part], _LOW_POW[: part.stop - part.start], out=body[part])
        body[part] *= high[k]
    np.cumsum(body, out=body)
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the bytes stand."""
    high = _powers(pow(_INVERSE, _LOW, 1 << 64), len(prefix) // _LOW + 1)
    h = prefix[ends] - prefix[starts]
    h *= _LOW_INV[starts & (_LOW - 1)]
    h *= high[starts >> 14]
    return mix(h)


#: Bytes of a long text whose prefix sums are held at once.
SPAN = 1 << 20


def _together(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Groups of ranges, in order and apart, that lie within about a span; a longer range is a group of its own."""
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + SPAN, side="right")))
        yield low, high
        low = high


def _long_hash(table: np.ndarray, data: np.ndarray) -> int:
    """What range_hashes gives before its scrambling, of all these bytes, a span at a time."""
    total = 0
    for low in range(0, len(data), SPAN):
        total += int(prefix_hashes(table[data[low : low + SPAN]])[-1]) * pow(_BASE, low, 1 << 64)
    return total % (1 << 64)


def hashes(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, in order and apart, a span of the text at a time; table gives each byte's value."""
    out = np.empty(len(starts), np.uint64)
    for low, high in _together(starts, ends):
        first, last = starts[low], ends[high - 1]
        if last - first > SPAN:
            out[low:high] = mix(np.array([_long_hash(table, data[first:last])], np.uint64))
            continue
        prefix = prefix_hashes(table[data[first:last]])
        out[low:high] = range_hashes(prefix, starts[low:high] - first, ends[low:high] - first)
    return out


def tally(member: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each range, in order and apart, are members; a span of the text at a time."""
    out = np.empty(len(starts), np.int64)
    for low, high in _together(starts, ends):
        first, last = starts[low], ends[high - 1]
        if last - first > SPAN:
            out[low] = sum(int(np.count_nonzero(member[data[a : min(last, a + SPAN)]])) for a in range(first, last, SPAN))
            continue
        sums = np.zeros(last - first + 1, np.int32)
        np.cumsum(member[data[first:last]], out=sums[1:])
        out[low:high] = sums[ends[low:high] - first] - sums[starts[low:high] - first]
    return out


def spans(data: np.ndarray, kinds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """The text in spans of `size` bytes or a little more; one ends where the kind of byte changes or the kind is 0, so that
    no run of one kind is cut."""
    low, n = 0, len(data)
    while low < n:
        high = min(n, low + size)
        while high < n:
            near = kinds[data[high - 1 : min(n, high + (1 << 16))]]
            found = np.flatnonzero((near[1:] != near[:-1]) | (near[1:] == 0))
            if len(found):
                high += int(found[0])
                break
            high = min(n, high + len(near) - 1)
        yield low, high
        low = high


def _word_table() -> np.ndarray:
    """Lower-cased byte of a word, or 0: digits, letters, and every byte of a character from U+0080."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            out[b] = b
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return out


WORD = _word_table()


class Words:
    """Words of some rows: byte ranges, hashes, the row of each, and how many each row has."""

    __slots__ = ("counts", "ends", "first", "hashes", "low", "row", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = WORD[data]
        self.starts, self.ends = runs(self.low != 0, offsets[:-1])
        self.hashes = hashes(BYTE_VALUES, self.low, self.starts, self.ends)
        bounds = np.searchsorted(self.starts, offsets)
        self.first, self.counts = bounds[:-1], np.diff(bounds)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, word: int, n: int) -> bytes:
        """n words from one on, a space between each."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[word : word + n].tolist(), self.ends[word : word + n].tolist(), strict=True))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text of any length, a span at a time."""
    found = [Words(data[a:b], np.array([0, b - a])).hashes for a, b in spans(data, (WORD != 0).astype(np.uint8), SPAN)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


_GRAM = 0xD1342543DE82EF95


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words from each word on, and which of them lie within one row."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= U(_GRAM)
        out += hashes[k : k + size]
    out += U(n)
    return mix(out), row[:size] == row[n - 1 :]
