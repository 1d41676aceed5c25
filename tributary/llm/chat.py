"""Chat formatting in budgeted windows.

A conversation's turns are written by a template that marks them, and cut into windows of at most ``BUDGET`` tokens: those
of the written, escaped turns with their marks. Turns begin and end where the tokenizer never joins, so a window has as
many tokens as its turns in sum. The running sum of turn tokens decides: a window's new turns go on while the sum since its
start fits beside what it repeats. What it repeats is fixed by its first new turn: the leading system turn if both fit, then
the latest earlier turns that fit in ``HISTORY`` tokens and in what is left. Windows begin and end at turns. Only assistant
texts that are new to a window are under its loss mask, so each is a target once.

A turn of more than ``BUDGET`` tokens has a window of its own, without repeats, flagged ``over``: no other window passes the
budget. A later window in which the system turn does not fit beside the first new turn, or where that turn has more than half
of the budget, goes without it and is flagged ``bare``.

Control strings in texts: ``<|`` in a text, with any backslashes between the two signs, gets one more backslash, and loses
it when read; so no text can make a mark, and every text comes back as it was.

Token counts are made before the shuffle. Conversations are then spread by id and sorted by turn; a task goes through its
sorted rows once and holds a window, never a conversation. A digest over a whole conversation must be taken in order, so
one conversation is one task's; it is streamed.

Defined cases: a null text is empty, a null role is an empty role; equal turn numbers are ordered by role and text; a
null conv_id is a conversation; a conversation without assistant turns has no loss text; an empty table has no windows; extra
columns are not read, whatever their names; a long turn is held whole by its task, a long conversation by windows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import shared, tokens
from tributary.llm.textcore import as_bytes, pieces

BUDGET, HISTORY = 2048, 512
# The template's marks.
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: line feeds are spelled out, backslashes doubled."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def written(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Windows:
    """Takes the turns of one conversation in order, gives windows: (text, loss spans, repeated turns, new turns, tokens, over,
    bare)."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, int] | None = None
        self.past: deque[tuple[str, int]] = deque()  # the latest turns of earlier windows, in `history` tokens
        self.past_tokens = 0
        self.repeats: list[tuple[str, int]] = []
        self.repeated = 0
        self.turns: list[tuple[str, str, int]] = []  # role, written turn, tokens
        self.total = self.start = 0  # running sums of tokens: of all turns, and where the window begins
        self.count = 0
        self.bare = False

    def add(self, role: str, text: str, size: int) -> Iterator[tuple]:
        if self.turns and self.total + size - self.start > self.budget - self.repeated:
            yield self.close()
        if not self.turns:
            self._open(size)
        self.turns.append((role, written(role, text), size))
        self.total += size
        if self.count == 0 and role == "system":
            self.system = (self.turns[0][1], size)
        self.count += 1

    def _open(self, size: int) -> None:
        """What a window repeats whose first new turn has so many tokens."""
        room = self.budget - size
        found: list[tuple[str, int]] = []
        self.bare = False
        if self.system:
            self.bare = self.system[1] > min(room, self.budget // 2)
            if not self.bare:
                found.append(self.system)
                room -= self.system[1]
        room = min(room, self.history)
        latest = []
        for turn in reversed(self.past):
            if turn[1] > room:
                break
            latest.append(turn)
            room -= turn[1]
        self.repeats = found + latest[::-1]
        self.repeated = sum(n for _, n in self.repeats)

    def close(self) -> tuple:
        out, loss = [x for x, _ in self.repeats], []
        at = sum(map(len, out))
        for role, turn, _ in self.turns:
            if role == "assistant":
                begin = at + len(START) + len(role) + 1
                loss.append((begin, at + len(turn) - len(END) - 1))
            out.append(turn)
            at += len(turn)
        for k, (_, turn, n) in enumerate(self.turns):
            if self.start == 0 and k == 0 and self.system:
                continue  # the system turn is repeated anyway
            self.past.append((turn, n))
            self.past_tokens += n
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[1]
        size = self.total - self.start + self.repeated
        result = ("".join(out), loss, len(self.repeats), len(self.turns), size, size > self.budget, self.bare)
        self.start, self.turns = self.total, []
        return result


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder_of(path)
        for batch in batches:
            turns = pa.array([written(*x) for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.large_string())
            data, offsets = as_bytes(turns)
            counts = [encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1] for a, b in pieces(offsets, tokens.PIECE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], names=[*batch.schema.names, "n"])

    return run


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = "conv_id long, window long, text string, loss array<struct<start: long, end: long>>, repeated int, fresh int, tokens long, over boolean, bare boolean"


def _former(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, windows, number, held = none, None, 0, []

        def full() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.string(), _LOSS, pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "window", "text", "loss", "repeated", "fresh", "tokens", "over", "bare"])

        def take(found: tuple) -> None:
            nonlocal number
            text, loss, *rest = found
            held.append((now, number, text, [{"start": a, "end": b} for a, b in loss], *rest))
            number += 1

        for batch in batches:
            for conv, role, text, n in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True):
                if conv != now:
                    if windows is not None:
                        take(windows.close())
                    now, windows, number = conv, Windows(budget, history), 0
                for found in windows.add(role, text, n):
                    take(found)
                if len(held) >= 256:
                    yield full()
                    held = []
        if windows is not None:
            take(windows.close())
        if held:
            yield full()

    return run


def form(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, window, text, loss, repeated, fresh, tokens, over, bare) of all conversations (conv_id, turn, role, text)."""
    shared.tune(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(_counter(tokenizer or tokens.vocabulary()), "conv_id long, turn long, role string, text string, n long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_former(budget, history), _OUT)


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    now, state, out = none, None, []

    def full() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def done() -> None:
        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv, text, loss, repeated in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True):
            if conv != now:
                if state is not None:
                    done()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for k, turn in enumerate(_TURN.finditer(text)):
                if k >= repeated:
                    state[0] += 1
                    state[1].update(f"{unescape_role(turn[1])}\n{unescape(turn[2])}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                target = unescape(text[span["start"] : span["end"]])
                state[2] += len(target)
                state[3].update(target.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        if len(out) >= 1000:
            yield full()
            out = []
    if state is not None:
        done()
    if out:
        yield full()


def digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows alone."""
    rows = windows.select("conv_id", "window", "text", "loss", "repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(_digester, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = shared.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    folder = shared.scratch(spark, "chat")
    form(turns.unionByName(more)).write.parquet(folder)
    return digests(spark.read.parquet(folder))
