"""Chat formatting in budgeted windows.

The turns of a conversation are cut into windows of at most ``budget`` tokens at turn
boundaries: running sums of the turns' tokens say how many more turns fit. A turn counts as
it is written, with its control strings and escapes; every turn ends with a line break and
starts with a control string, so the pieces that tokens are made of never span two turns
and the sums are exact. Every window starts with the conversation's system turns; all but
the first then repeat the last turns before them, up to ``history`` tokens and as far as
a new turn still fits. A window therefore reads on its own, and each turn is new in exactly
one of them. Only new assistant turns are targets: repeated ones are masked. A turn is never
cut; one that doesn't fit beside the system turns gets a window with them, without history.

A turn is written as ``<|turn|>role<|text|>text<|end|>`` and a line break. Control strings,
the template's own and those of a common chat template, are escaped inside roles and
texts by a backslash behind their first character (one more if there are some already),
which ``unescape`` takes away again: after escaping no control string is left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tallyline.llm.common import field, read_vocabulary
from tallyline.llm.token_counts import counter

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First character and rest of the strings that texts may not contain.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]+\|>)")
SYSTEM, TARGET = "system", "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def _written(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and end of a turn."""
    return f"{TURN}{escape(role)}{TEXT}", escape(text), END + "\n"


class _Windows:
    """Builds the windows of one conversation from its turns in order."""

    def __init__(self, conversation, budget: int, history: int, count):
        self.id, self.budget, self.history, self.count = conversation, budget, history, count
        self.system: list[tuple] = []  # (number, role, text, tokens)
        self.before: list[tuple] = []  # turns that the next window may repeat
        self.waiting: list[tuple] = []  # new turns of the next window
        self.turns = self.windows = 0
        self.opening = True

    def add(self, role: str, text: str) -> Iterator[list]:
        turn = (self.turns, role, text, self.count("".join(_written(role, text))))
        self.turns += 1
        self.waiting.append(turn)
        if self.opening and role == SYSTEM:
            self.system.append(turn)
            return
        self.opening = False
        while (fits := self._fitting()) < len(self.waiting):
            yield self._window(fits)

    def finish(self) -> Iterator[list]:
        if self.waiting:
            yield self._window(len(self.waiting))

    def _repeated(self) -> list[tuple]:
        """System turns, then the last turns before this window that leave room for a new one."""
        if not self.windows:
            return []
        room = self.budget - sum(t[3] for t in self.system) - self.waiting[0][3]
        return self.system + self._last(self.before, min(self.history, room))

    def _fitting(self) -> int:
        """How many of the waiting turns the next window takes: at least one."""
        used = sum(t[3] for t in self._repeated())
        sums = np.array(list(accumulate(t[3] for t in self.waiting)))
        # the opening system turns stay with the first turn after them
        least = min(len(self.waiting), 1 + (0 if self.windows else len(self.system)))
        return max(least, int(np.searchsorted(sums, self.budget - used, side="right")))

    def _window(self, size: int) -> list:
        repeated, new = self._repeated(), self.waiting[:size]
        self.waiting = self.waiting[size:]
        out, at, parts, loss = [], 0, [], []
        for turns, again in ((repeated, True), (new, False)):
            for number, role, text, _ in turns:
                head, body, tail = _written(role, text)
                start, at = at, at + len(head) + len(body) + len(tail)
                out += [head, body, tail]
                parts.append({"start": start, "end": at, "turn": number, "repeated": again})
                if role == TARGET and not again:
                    loss.append({"start": start + len(head), "end": start + len(head) + len(body)})
        own = [t for t in new if t not in self.system] if not self.windows else new
        self.before = self._last(self.before + own, self.history)
        self.windows += 1
        return [self.id, self.windows - 1, "".join(out), parts, loss]

    @staticmethod
    def _last(turns: list[tuple], most: int) -> list[tuple]:
        """The last turns, of ``most`` tokens together."""
        tokens = np.cumsum([t[3] for t in reversed(turns)])
        keep = int(np.searchsorted(tokens, most, side="right"))
        return turns[-keep:] if keep else []


def _batches(rows: Iterator[list], schema: pa.Schema, at_once: int = 200) -> Iterator[pa.RecordBatch]:
    waiting: list[list] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def format_chat(
    turns: DataFrame,
    vocabulary: str,
    budget: int = 1024,
    history: int = 256,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Windows of formatted turns: (conversation, window, formatted, parts, loss).

    ``parts`` has for each turn in ``formatted`` its span in code points, its number
    in the conversation and whether it is a repetition; ``loss`` has the spans of the
    target texts. Tokens are counted with the byte-level BPE file ``vocabulary``.

    Turns are ordered by number, then role, then text, so ties and repeated rows give
    the same windows on every run. Null roles and texts are empty; a null conversation
    id is an id; an empty table gives an empty result; other columns are ignored. A
    task streams over its conversations: it holds one window and the history, however
    many turns a conversation has. A very long text is held whole while its turn is written;
    ``budget`` then can't be kept: the window has that turn and the system turns only.
    """
    file = turns.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    span = [StructField("start", IntegerType()), StructField("end", IntegerType())]
    part = StructType([*span, StructField("turn", IntegerType()), StructField("repeated", BooleanType())])
    schema = StructType(
        [
            field(turns, conv_col),
            StructField("window", IntegerType()),
            StructField("formatted", StringType()),
            StructField("parts", ArrayType(part)),
            StructField("loss", ArrayType(StructType(span))),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        count, current = counter(file.value).count, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for conversation, role, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if current is None or current.id != conversation:
                        if current is not None:
                            yield from current.finish()
                        current = _Windows(conversation, budget, history, count)
                    yield from current.add(role, text)
        if current is not None:
            yield from current.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _arrow(schema))

    empty = F.lit("")
    ordered = (
        turns.select(
            F.col(conv_col),
            F.coalesce(F.col(role_col).cast("string"), empty).alias("__role"),
            F.coalesce(F.col(text_col).cast("string"), empty).alias("__text"),
            F.col(turn_col).alias("__turn"),
        )
        .repartition(conv_col)
        .sortWithinPartitions(conv_col, "__turn", "__role", "__text")
        .select(conv_col, "__role", "__text")
    )
    return ordered.mapInArrow(run, schema)


def read_turns(formatted: str, parts: list[dict]) -> list[tuple[str, str]]:
    """The new turns of a window as (role, text), read from what was written."""
    turns = []
    for part in parts:
        if not part["repeated"]:
            written = formatted[part["start"] : part["end"]]
            role, mark, text = written.removeprefix(TURN).partition(TEXT)
            if not written.startswith(TURN) or not mark or not text.endswith(END + "\n"):
                raise ValueError("not a turn: " + written[:80])
            turns.append((unescape(role), unescape(text[: -len(END) - 1])))
    return turns


def read_back(windows: DataFrame, conv_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Digests per conversation of what ``format_chat`` wrote.

    Windows are brought in order first, unless ``in_order`` says that they come as
    ``format_chat`` returned them, not from a table that was written and read again.

    (conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the
    digest of role, line break, text, line break of each turn; number of code points
    and digest of all unescaped text under the loss mask; code points of all windows.
    """
    schema = StructType(
        [
            windows.schema[conv_col],
            StructField("n_turns", LongType()),
            StructField("turns_sha256", StringType()),
            StructField("loss_chars", LongType()),
            StructField("loss_sha256", StringType()),
            StructField("formatted_chars", LongType()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        current = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (conv_col, "formatted", "parts", "loss"))
            for conversation, formatted, parts, loss in zip(*columns):
                if current is None or current[0] != conversation:
                    if current:
                        yield closed(current)
                    current = [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted, parts):
                    current[1] += 1
                    current[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    current[3] += len(text)
                    current[4].update(text.encode())
                current[5] += len(formatted)
        if current:
            yield closed(current)

    def closed(row: list) -> list:
        return [row[0], row[1], row[2].hexdigest(), row[3], row[4].hexdigest(), row[5]]

    rows_in = windows.select(conv_col, "window", "formatted", "parts", "loss")
    if not in_order:
        rows_in = rows_in.repartition(conv_col).sortWithinPartitions(conv_col, "window")
    return rows_in.mapInArrow(lambda b: _batches(rows(b), _arrow(schema)), schema)
