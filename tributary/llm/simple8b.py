"""Simple-8b: word-aligned packing of non-negative 64-bit ids.

A 64-bit word has a 4-bit selector, which says how many ids of how many bits its other 60 bits hold. Selector 0 is an
escape: the next word is one id as it is, for ids of more than 60 bits. Ids are packed in groups of ``GROUP``, each of which
begins at a word of its own; the words' offsets of the groups let all groups be packed, and read, side by side in numpy.
"""

from __future__ import annotations

import numpy as np

GROUP = 128
# How many ids a word holds by selector, and their bits; selector 0 is the escape, 1 is not used.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = 60


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[:, :-by] = x[:, by:]
    return out


def _selectors(widths: np.ndarray) -> np.ndarray:
    """The selector that packs most ids from each place on; past the end of a group ids are 0."""
    most = {1: widths}
    for count, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 15, 5), (30, 15, 15), (60, 30, 30)):
        most[count] = np.maximum(most[a], _shift(most[b], count - b) if count - b == a else _shift(most[b], a))
    out = np.zeros(widths.shape, np.int8)
    for selector in range(15, 1, -1):
        np.copyto(out, np.int8(selector), where=most[int(COUNTS[selector])] <= BITS[selector])
    return out


def _widths(ids: np.ndarray) -> np.ndarray:
    top = int(ids.max(initial=0))
    if top < 1 << 16:
        return _SMALL[ids.astype(np.int64)]
    out = np.zeros(ids.shape, np.uint8)
    for bit in range(top.bit_length()):
        out[ids >> np.uint64(bit) > 0] = bit + 1
    return out


_SMALL = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


#: Groups that are packed or read at once, which bounds memory.
TOGETHER = 512


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset in them of each group."""
    if len(ids) <= TOGETHER * GROUP:
        return _encode(ids)
    words, offsets, held = [], [], 0
    for low in range(0, len(ids), TOGETHER * GROUP):
        more, at = _encode(ids[low : low + TOGETHER * GROUP])
        words.append(more)
        offsets.append(at + held)
        held += len(more)
    return np.concatenate(words), np.concatenate(offsets)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids that `encode` packed."""
    if len(offsets) <= TOGETHER:
        return _decode(words, offsets, n)
    out, ends = np.empty(n, np.uint64), np.append(offsets, len(words))
    for low in range(0, len(offsets), TOGETHER):
        high = min(low + TOGETHER, len(offsets))
        part = slice(low * GROUP, min(n, high * GROUP))
        out[part] = _decode(words[ends[low] : ends[high]], offsets[low:high] - ends[low], part.stop - part.start)
    return out


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(ids, np.uint64)
    groups = -(-len(ids) // GROUP)
    if not groups:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grid = np.zeros((groups, GROUP + _PAD), np.uint64)
    full = np.zeros(groups * GROUP, np.uint64)
    full[: len(ids)] = ids
    grid[:, :GROUP] = full.reshape(groups, GROUP)
    lengths = np.full(groups, GROUP)
    lengths[-1] = len(ids) - GROUP * (groups - 1)
    selectors = _selectors(_widths(grid[:, :GROUP]))
    row, at, word = np.arange(groups), np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    sizes = np.zeros(groups, np.int64)
    while len(row):
        selector = selectors[row, at]
        taken.append((row, at, word, selector))
        at, word = at + COUNTS[selector], word + np.where(selector == 0, 2, 1)
        going = at < lengths[row]
        sizes[row[~going]] = word[~going]
        row, at, word = row[going], at[going], word[going]
    row, at, word, selector = (np.concatenate(x) for x in zip(*taken, strict=True))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], np.uint64)
    place, flat = offsets[row] + word, row * (GROUP + _PAD) + at
    cells = grid.ravel()
    for k in np.unique(selector).tolist():
        mine = selector == k
        if k == 0:
            out[place[mine] + 1] = cells[flat[mine]]
            continue
        packed = np.full(mine.sum(), k, np.uint64)
        start = flat[mine]
        for j in range(int(COUNTS[k])):
            packed |= cells[start + j] << np.uint64(4 + j * int(BITS[k]))
        out[place[mine]] = packed
    return out, offsets[:-1]


def _decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    groups = len(offsets)
    if not groups:
        return np.zeros(0, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == 0).tolist():  # an escape's second word has no selector
        if not raw[k]:
            raw[k + 1] = True
    counts = np.where(raw, 0, COUNTS[selector])
    before = np.cumsum(counts) - counts
    group = np.repeat(np.arange(groups), np.diff(np.append(offsets, len(words))))
    place = before - before[offsets][group] + group * (GROUP + _PAD)
    out = np.zeros(groups * (GROUP + _PAD), np.uint64)
    for k in np.unique(selector[~raw]).tolist():
        mine = np.flatnonzero((selector == k) & ~raw)
        if k == 0:
            out[place[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(BITS[k])) - 1)
        for j in range(int(COUNTS[k])):
            out[place[mine] + j] = words[mine] >> np.uint64(4 + j * int(BITS[k])) & mask
    return out.reshape(groups, GROUP + _PAD)[:, :GROUP].ravel()[:n]
