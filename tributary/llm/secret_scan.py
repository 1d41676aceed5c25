"""Secret scans: base patterns, and a linear-chain conditional random field that adds what they do not name.

Tokens are runs of ASCII letters, digits, ``_ - . + /`` or characters from U+0080, and runs of other printable ASCII; a line
is a sequence. Each token has hashed features: its shape and length, its word, its first four bytes, the two tokens before
and the one after, how letters and digits change in it, and features of its file (shares of digits and of punctuation).
A tag is O, B or I (outside, begin, inside a secret); I never follows O nor starts a line. Weights are learned by gradient
descent on the exact log-likelihood, from at most ``SAMPLE`` snippets around base matches (those of least checksum in all
documents), as many snippets without one (out of about ``AHEAD * SAMPLE`` documents of least checksum), and the latter again
with made-up keys of well-known forms inside. Decoding is Viterbi over whole lines: the tokens of a batch are one chain that
restarts at each line, cut in blocks; all blocks are solved side by side for each state they may begin in, joined by a chain
over blocks, then traced back side by side. That is exact. A text of more than ``LONG`` bytes is tagged in spans that end at a
line's end; of a longer line each span is a sequence, and spans of secrets that touch are one.

Base spans always stay and cover the whole match of their pattern. A decoded span is added (kind `crf`) if it has at least
``LEAST`` characters and does not overlap a base span.

Defined cases: a null text is empty and has no spans; repeated rows each give a row; with no snippets only base spans are given;
an empty table gives no rows and a model of no snippets; snippets of equal checksum are taken in order of their text; extra
columns may have any name, as they travel in a struct. Base patterns run over a whole text at once, with two copies of its
bytes; all else is held by spans: about 10 bytes of memory for each byte of a text, and 300 MB.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm import shared
from tributary.llm.textcore import BYTE_VALUES, as_bytes, hashes, mix, pieces, runs, spans, tally

# The base patterns.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

LEAST = 8
SAMPLE, AHEAD = 2000, 24
CONTEXT, WIDTH = 160, 96
SPACE = 1 << 16
PIECE = 1 << 20
#: A text of more bytes is tagged in spans of about a piece.
LONG = 2 << 20
U = np.uint64

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_BODY, _SIGN, _LOWER, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(5))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_BODY[128:] = True
_BODY |= _LOWER | _UPPER | _DIGIT
_BODY[list(b"_-.+/")] = True
_SIGN[33:127] = ~_BODY[33:127]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def base(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each row, (start, kind, end) of the base patterns' matches, in bytes."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    starts, ends = runs(_HEX[data], offsets[:-1])
    long = np.flatnonzero(ends - starts >= HEX_LEAST)
    rows = np.searchsorted(offsets, starts[long], side="right") - 1
    for row, a, b in zip(rows.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[row].append((a - int(offsets[row]), 2, b - int(offsets[row])))
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[low:high].tobytes()
        if b"AKIA" in text:
            out[row] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        folded = text.lower()
        if any(x in folded for x in _CUES):
            out[row] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        out[row].sort()
    return out


_ONE = np.arange(256) == 1
_KINDS = _BODY.astype(np.uint8) + 2 * _SIGN.astype(np.uint8)


def _file(total: np.ndarray, digits: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The features of files with so many tokens, tokens with digits, and tokens of signs."""
    total = np.maximum(total, 1)
    return np.minimum(digits * 16 // total, 7) * 8 + np.minimum(signs * 16 // total, 7)


def _file_of(data: np.ndarray) -> np.ndarray:
    """The features of one file, a span at a time."""
    seen = np.zeros((3, 1), np.int64)
    for low, high in spans(data, _KINDS, PIECE):
        part, zero = data[low:high], np.array([0])
        starts, ends = runs(_BODY[part], zero)
        signs = len(runs(_SIGN[part], zero)[0])
        seen[:, 0] += len(starts) + signs, np.count_nonzero(tally(_DIGIT, part, starts, ends)), signs
    return _file(*seen)


def _lines(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about a piece; one ends at a line's end, or, if the line is longer, where a token does."""
    low, n = 0, len(data)
    while low < n:
        high = min(n, low + PIECE)
        if high < n:
            ends = np.flatnonzero(data[low:high] == 10)
            high = low + (int(ends[-1]) + 1 if len(ends) else next(spans(data[low:], _KINDS, PIECE))[1])
        yield low, high
        low = high


class Chain:
    """Tokens of some rows with their features; first: which tokens start a line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, file_bits: np.ndarray | None = None):
        (a, b), (c, d) = runs(_BODY[data], offsets[:-1]), runs(_SIGN[data], offsets[:-1])
        starts = np.concatenate([a, c])
        order = np.argsort(starts, kind="stable")
        self.starts, self.ends = starts[order], np.concatenate([b, d])[order]
        n = len(self.starts)
        count = lambda member: tally(member, data, self.starts, self.ends)
        lines = np.searchsorted(np.flatnonzero(data == 10), self.starts)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.ones(n, bool)
        self.first[1:] = (lines[1:] != lines[:-1]) | (self.row[1:] != self.row[:-1])
        size = self.ends - self.starts
        lower, upper, digit, body, hexes = (count(x) for x in (_LOWER, _UPPER, _DIGIT, _BODY, _HEX))
        change = np.zeros(len(data), np.uint8)
        change[1:] = _DIGIT[data[1:]] != _DIGIT[data[:-1]]
        turns = np.minimum(tally(_ONE, change, np.minimum(self.starts + 1, self.ends), self.ends), 15)
        length = np.minimum(np.log2(np.maximum(size, 1)) * 2, 15).astype(np.int64)
        shape = (lower > 0) | (upper > 0) << 1 | (digit > 0) << 2 | (body == 0) << 3 | (hexes == size) << 4 | (lower + upper + digit < body) << 5
        if file_bits is None:
            rows = len(offsets) - 1
            file_bits = _file(*(np.bincount(self.row[x], minlength=rows) for x in (slice(None), digit > 0, body == 0)))
        self.file = file_bits
        word = hashes(BYTE_VALUES[_FOLD], data, self.starts, self.ends)
        head = hashes(BYTE_VALUES, data, self.starts, np.minimum(self.starts + 4, self.ends))
        near = lambda by: np.concatenate([np.zeros(by, np.uint64), word[:-by]]) if n > by else np.zeros(n, np.uint64)
        before, before2 = near(1), near(2)
        after = np.concatenate([word[1:], np.zeros(min(n, 1), np.uint64)])
        line_end = np.append(self.first[1:], True) if n else np.zeros(0, bool)
        before[self.first] = 0
        before2[self.first | np.concatenate([[True], self.first[:-1]])[:n]] = 0
        after[line_end] = 0
        form = (length * 64 + shape).astype(np.uint64)
        kinds = [form, word, head, before, before2, after, (turns * 1024).astype(np.uint64) + form, self.file[self.row].astype(np.uint64) * U(2048) + form]
        self.features = np.stack([(mix(x + U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(48)).astype(np.int32) for k, x in enumerate(kinds)]) if n else np.zeros((8, 0), np.int32)


NEVER = np.float32(-1e6)
BLOCK = 64


class Crf:
    """Weights of hashed features by tag (O, B, I), of tag pairs, and of the first tag."""

    def __init__(self) -> None:
        self.weights = np.zeros((SPACE, 3), np.float32)
        self.pairs = np.zeros((3, 3), np.float32)
        self.start = np.zeros(3, np.float32)

    def _limits(self) -> tuple[np.ndarray, np.ndarray]:
        pairs, start = self.pairs.copy(), self.start.copy()
        pairs[0, 2] = start[2] = NEVER
        return pairs, start

    def decode(self, chain: Chain) -> np.ndarray:
        """The best tags of all lines."""
        n = len(chain.starts)
        if not n:
            return np.zeros(0, np.int8)
        scores = np.zeros((n, 3), np.float32)
        for index in chain.features:
            scores += self.weights[index]
        blocks = -(-n // BLOCK)
        held = np.zeros((blocks * BLOCK, 3), np.float32)
        held[:n] = scores
        starts = np.zeros(blocks * BLOCK, bool)
        starts[:n] = chain.first
        starts[n:] = True
        held, starts = held.reshape(blocks, BLOCK, 3), starts.reshape(blocks, BLOCK)
        pairs, start = self._limits()

        def step(best: np.ndarray, t: int) -> np.ndarray:
            """(..., blocks, 3) scores at t-1 to (..., blocks, from, to) at t, without t's own scores."""
            moved = best[..., :, None] + pairs
            return np.where(starts[:, t, None, None], best[..., :, None] + start, moved)

        best = np.full((3, blocks, 3), NEVER, np.float32)
        for k in range(3):
            best[k, :, k] = 0  # the state before the block
        for t in range(BLOCK):
            best = step(best, t).max(axis=-2) + held[:, t]
        through = best.transpose(1, 0, 2)  # of each block: from the state before it to its last state
        back = np.zeros((blocks, 3), np.int8)
        score = np.array([0, NEVER, NEVER], np.float32)
        for b in range(blocks):
            moved = score[:, None] + through[b]
            back[b] = moved.argmax(axis=0)
            score = moved.max(axis=0)
            score -= score.max()
        last = np.zeros(blocks, np.int8)
        entry = np.zeros(blocks, np.int8)
        state = int(score.argmax())
        for b in range(blocks - 1, -1, -1):
            last[b] = state
            state = int(back[b, state])
            entry[b] = state
        best = np.full((blocks, 3), NEVER, np.float32)
        best[np.arange(blocks), entry] = 0
        pointers = np.zeros((BLOCK, blocks, 3), np.int8)
        for t in range(BLOCK):
            moved = step(best, t)
            pointers[t] = moved.argmax(axis=-2)
            best = moved.max(axis=-2) + held[:, t]
        tags = np.zeros((blocks, BLOCK), np.int8)
        state = last.copy()
        for t in range(BLOCK - 1, -1, -1):
            tags[:, t] = state
            state = pointers[t][np.arange(blocks), state]
        return tags.ravel()[:n]

    def fit(self, index: np.ndarray, tags: np.ndarray, mask: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.3) -> None:
        """Gradient descent (per-weight steps) on the log-likelihood; index: (lines, WIDTH, features), padded by mask."""
        rng = np.random.default_rng(5)
        squares = [np.full_like(x, 1e-2) for x in (self.weights, self.pairs, self.start)]
        lines = len(tags)
        for _ in range(epochs):
            order = rng.permutation(lines)
            for low in range(0, lines, batch):
                k = order[low : low + batch]
                feats, truth, live = index[k], tags[k], mask[k]
                scores = self.weights[feats].sum(axis=2)
                node, pair = self._expected(scores, live)
                node -= np.eye(3)[truth] * live[..., None]
                both = live[:, 1:] & live[:, :-1]
                seen = np.zeros((3, 3))
                np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
                grad = np.zeros_like(self.weights)
                np.add.at(grad, feats[live].ravel(), np.repeat(node[live], feats.shape[2], axis=0).astype(np.float32))
                for x, g, s in zip((self.weights, self.pairs, self.start), (grad, pair - seen, node[:, 0].sum(axis=0)), squares, strict=True):
                    g = (g / len(k) + 1e-5 * x).astype(np.float32)
                    s += g * g
                    x -= rate * g / np.sqrt(s)

    def _expected(self, scores: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tags of each token and expected tag pairs, by the forward-backward algorithm."""
        pairs, start = (x.astype(float) for x in self._limits())
        total = lambda x, axis: (m := x.max(axis=axis, keepdims=True), np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis))[1]
        lines, width, _ = scores.shape
        forward, backward = np.zeros((lines, width, 3)), np.zeros((lines, width, 3))
        forward[:, 0] = start + scores[:, 0]
        for t in range(1, width):
            now = total(forward[:, t - 1, :, None] + pairs, 1) + scores[:, t]
            forward[:, t] = np.where(live[:, t, None], now, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            now = total(pairs + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], now, 0)
        whole = total(forward[:, -1], 1)[:, None, None]
        node = np.exp(forward + backward - whole) * live[..., None]
        pair = np.zeros((3, 3))
        for t in range(1, width):
            p = np.exp(forward[:, t - 1, :, None] + pairs + (scores[:, t] + backward[:, t])[:, None, :] - whole)
            pair += p[live[:, t]].sum(axis=0)
        return node, pair


def _made_up(rng: np.random.Generator) -> str:
    """A key of a well-known form."""
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    # Prefixes and lengths of key forms.
    forms = [("ghp_", 36, ""), ("gho_", 36, ""), ("glpat-", 20, ""), ("sk_live_", 24, ""), ("sk-", 40, ""), ("xoxb-", 40, ""), ("AIza", 35, "-_"), ("npm_", 36, ""), ("SG.", 40, "-_."), ("eyJ", 60, "-_."), ("", 40, "/+"), ("", 32, "")]
    prefix, n, more = forms[int(rng.integers(len(forms)))]
    return prefix + pick(alnum + more * 4, n)


def _tag(chain: Chain, spans: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(chain.starts), np.int64)
    for low, high in spans:
        inside = np.flatnonzero((chain.starts < high) & (chain.ends > low))
        tags[inside] = 2
        tags[inside[:1]] = 1
    return tags


def _secret(text: bytes, start: int, kind: int, end: int) -> tuple[int, int]:
    """The part of a base match that is the secret."""
    if kind == 0 and (m := ASSIGN.match(text, start)):
        return m.span(2)
    return start, end


def _snippets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(text) to (positive, rank, file, text): a snippet around a base match of each row that has one, and of each other row
    whose rank, the text's checksum, is at most `most`; a task keeps the SAMPLE of least rank with a match, and without."""
    kept: dict[bool, list] = {True: [], False: []}
    bound = {True: 1 << 32, False: most}  # greater ranks are not kept
    for batch in batches:
        data, offsets = as_bytes(batch.column(0))
        for low, high in pieces(offsets, PIECE):
            part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            ranks = [zlib.crc32(part[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if min(ranks) > max(bound.values()):
                continue
            found = base(part, at)
            for k, rank in enumerate(ranks):
                positive = bool(found[k])
                if rank > bound[positive]:
                    continue
                text = part[at[k] : at[k + 1]].tobytes()
                middle = found[k][rank % len(found[k])][0] if positive else rank % max(1, len(text))
                snippet = text[max(0, middle - CONTEXT) : middle + CONTEXT]
                snippet = snippet.decode("utf-8", "ignore")
                if snippet and positive == bool(base(*as_bytes(pa.array([snippet])))[0]):
                    kept[positive].append((rank, int(_file_of(part[at[k] : at[k + 1]])[0]), snippet))
        for k, rows in kept.items():
            if len(rows) > SAMPLE:
                kept[k] = sorted(set(rows))[:SAMPLE]
                if len(kept[k]) == SAMPLE:
                    bound[k] = kept[k][-1][0]
    rows = [(k, *x) for k in kept for x in sorted(set(kept[k]))]
    a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.bool_()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["positive", "rank", "file", "text"])


def fit(docs: DataFrame, text: str = "text") -> Crf:
    """A model learned from at most SAMPLE snippets with a base match and as many without."""
    shared.tune(docs.sparkSession)
    # of those without a match about AHEAD * SAMPLE rows are looked at, however many there are
    most = int((1 << 32) * min(1.0, AHEAD * SAMPLE / max(1, docs.count())))
    rows = shared.cut(docs.select(F.col(f"`{text}`").alias("text")).where("text <> ''").mapInArrow(lambda x: _snippets(x, most), "positive boolean, rank long, file long, text string"))
    # the least are found by executors, so the driver gets SAMPLE rows whatever the number of tasks
    least = lambda flag: [(x.file, x.text) for x in shared.cut(rows.where(F.col("positive") == flag).orderBy("rank", "text", "file").limit(SAMPLE)).collect()]
    rng = np.random.default_rng(11)
    lines: list[tuple[int, bytes, list[tuple[int, int]]]] = []
    for file, held in least(True):
        raw = held.encode()
        lines.append((file, raw, [_secret(raw, *x) for x in base(*as_bytes(pa.array([raw], pa.binary())))[0]]))
    for file, held in least(False):
        raw = held.encode()
        lines.append((file, raw, []))
        places = [m.end() for m in re.finditer(rb" ", raw)] or [0]
        at, key = places[int(rng.integers(len(places)))], _made_up(rng).encode()
        cue = [b"", b"key ", b"key: ", b"Authorization: Bearer ", b"auth=", b'"']
        lead = cue[int(rng.integers(len(cue)))]
        tail = b'" ' if lead == b'"' else b" "
        lines.append((file, raw[:at] + lead + key + tail + raw[at:], [(at + len(lead), at + len(lead) + len(key))]))
    model = Crf()
    index, tags, mask = [], [], []
    for file, raw, spans in lines:
        data, offsets = as_bytes(pa.array([raw], pa.binary()))
        chain = Chain(data, offsets, np.array([file]))
        marked = _tag(chain, spans)
        breaks = np.flatnonzero(chain.first)
        for a, b in zip(breaks, np.append(breaks[1:], len(marked)), strict=True):
            b = min(b, a + WIDTH)
            feats, truth, live = np.zeros((WIDTH, 8), np.int32), np.zeros(WIDTH, np.int64), np.zeros(WIDTH, bool)
            feats[: b - a], truth[: b - a], live[: b - a] = chain.features[:, a:b].T, marked[a:b], True
            if truth[0] == 2:
                truth[0] = 1
            index.append(feats)
            tags.append(truth)
            mask.append(live)
    if index:
        model.fit(np.stack(index), np.stack(tags), np.stack(mask))
    return model


def _points(data: np.ndarray, places: list[int]) -> dict[int, int]:
    """How many code points begin before each of these byte places."""
    out, last, held = {}, 0, 0
    for place in sorted(set(places)):
        for low in range(last, place, PIECE):
            held += int(np.count_nonzero((data[low : min(place, low + PIECE)] & 0xC0) != 0x80))
        out[place], last = held, place
    return out


def _tagged(part: np.ndarray, at: np.ndarray, model: Crf, file_bits: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the decoded spans, in bytes of the row."""
    chain = Chain(part, at, file_bits)
    tags = model.decode(chain)
    inside = np.append((tags == 2) & ~chain.first, False)
    begins = np.flatnonzero(tags == 1)
    stops = np.flatnonzero(~inside)
    ends = stops[np.searchsorted(stops, begins + 1)] - 1
    rows = chain.row[begins]
    yield from zip(rows.tolist(), (chain.starts[begins] - at[rows]).tolist(), (chain.ends[ends] - at[rows]).tolist(), strict=True)


def _added(part: np.ndarray, at: np.ndarray, model: Crf) -> Iterator[tuple[int, int, int]]:
    if len(at) != 2 or len(part) <= LONG:
        yield from _tagged(part, at, model)
        return
    bits, held = _file_of(part), None
    for low, high in _lines(part):
        for _, start, end in _tagged(part[low:high], np.array([0, high - low]), model, bits):
            if held and start == 0 and held[1] == low:
                held = (held[0], low + end)
                continue
            if held:
                yield 0, *held
            held = (low + start, low + end)
    if held:
        yield 0, *held


def _clear(found: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those spans that overlap no base span."""
    joined: list[list[int]] = []
    for a, _, b in found:  # in order of their starts
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    ends = [b for _, b in joined]
    out = []
    for start, end in spans:
        k = bisect_left(ends, start + 1)  # the first that ends after the start
        if k == len(joined) or end <= joined[k][0]:
            out.append((start, end))
    return out


def scan(column: pa.Array, model: Crf | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each row, its base spans and the added ones, as (start, kind, end) in code points."""
    data, offsets = as_bytes(column)
    out = []
    for low, high in pieces(offsets, PIECE):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        found = base(part, at)
        added: list[list[tuple[int, int]]] = [[] for _ in found]
        if model is not None:
            for row, start, end in _added(part, at, model):
                added[row].append((start, end))
        for k, (mine, more) in enumerate(zip(found, added, strict=True)):
            more = _clear(mine, more)
            if not mine and not more:
                out.append(([], []))
                continue
            point = _points(part[at[k] : at[k + 1]], [y for a, _, b in mine for y in (a, b)] + [y for x in more for y in x])
            spans_of = ([(point[a], kind, point[b]) for a, kind, b in mine], [(point[a], 3, point[b]) for a, b in more if point[b] - point[a] >= LEAST])
            out.append(spans_of)
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def annotate(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """(row, base, added): the input's row as a struct; spans as arrays of (kind, start, end) in code points."""
    shared.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            found = scan(row.field(row.type.get_field_index(text)), held.value)
            columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(x[side])] for x in found], kind) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([row, *columns], names=["row", "base", "added"])

    return frame.mapInArrow(run, T.StructType([frame.schema["row"], T.StructField("base", span), T.StructField("added", span)]))


def report(docs: DataFrame, model: Crf | None) -> DataFrame:
    found = annotate(docs.select("doc_id", "text"), model)
    order = F.array(*[F.lit(x) for x in KINDS])
    told = lambda spans: F.concat_ws(",", F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], F.array_position(order, x["kind"]), x["end"], x["kind"].alias("kind")))), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.concat("base", "added")).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return report(docs, fit(docs))
