"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_chats`` turns rows by turn into segments with loss flags; the text of a conversation is
its segments joined in order.  ``read_chats`` parses such segments back into turns.

Both stream over rows sorted by conversation and turn: a conversation never has to fit in memory,
only a turn does.  Control strings and the escape character inside texts are escaped, so reading
back gives the texts unchanged.

Defined cases: a null text or role is the empty string; turns sort by (turn, role, text), nulls
first, so ties and repeated rows are all kept in a stable order; all rows with a null conversation id are
one conversation, which one task streams; turn orders that the machine doesn't allow are formatted all the same and
counted in ``n_violations``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ROWS = 2048


@dataclass(frozen=True)
class ChatTemplate:
    """Headers by role, the end of a turn, roles under the loss, and the allowed turn orders."""

    headers: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "})
    other: str = "### Role "
    end: str = " </turn>\n"
    loss: tuple = ("assistant",)
    escape: str = "\\"
    controls: tuple = ("### ", "###", "</turn>")
    start: str = "start"
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "called"},
        "called": {"assistant": "answered", "tool": "called"},
    })
    final: tuple = ("answered",)

    def guard(self, text: str, more: str = "") -> str:
        """Escape control strings, the escape character and characters of ``more``."""
        what = sorted([self.escape, *self.controls, *more], key=len, reverse=True)
        return re.sub("|".join(map(re.escape, what)), lambda m: self.escape + m[0], text)

    def unguard(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        head = self.headers.get(role)
        head = f"{self.other}{self.guard(role, ':')}: " if head is None else head
        return [(head, False), (self.guard(text), role in self.loss), (self.end, False)]

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state; after a forbidden turn the machine goes where that role usually leads."""
        to = self.moves.get(state, {}).get(role)
        if to:
            return to, True
        return next((m[role] for m in self.moves.values() if role in m), state), False


SEGMENTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("segment", T.StringType()), T.StructField("loss", T.BooleanType()), T.StructField("allowed", T.BooleanType()),
])
READ = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("n_violations", T.LongType()), T.StructField("complete", T.BooleanType()),
])


def _batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield made()
            held = []
    if held:
        yield made()


def format_chats(df: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments of every conversation: conv_id, seq (order), turn (index), segment, loss, allowed."""
    template = template or ChatTemplate()
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments():
            last, state, seq, turn = object(), template.start, 0, 0
            for batch in batches:
                for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if conv != last:
                        last, state, seq, turn = conv, template.start, 0, 0
                    state, allowed = template.step(state, role or "")
                    for piece, loss in template.segments(role or "", text or ""):
                        yield conv, seq, turn, piece, loss, allowed
                        seq += 1
                    turn += 1

        yield from _batches(segments(), SEGMENTS)

    return rows.mapInArrow(run, SEGMENTS)


class TurnReader:
    """Incremental parser of one formatted conversation: feeds of text, turns out."""

    def __init__(self, template: ChatTemplate):
        self.t, self.held, self.mask = template, [], []
        self.stop = re.compile(re.escape(template.escape) + ".|" + f"({re.escape(template.end)})", re.S)
        self.colon = re.compile(re.escape(template.escape) + ".|(: )", re.S)

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """(role, text, the part under the loss) of each turn that this segment ends."""
        self.held.append(text)
        if loss:
            self.mask.append(text)
        if not text.endswith(self.t.end):
            return
        whole = "".join(self.held)
        at = 0
        for m in self.stop.finditer(whole):
            if m[1]:
                yield (*self.parse(whole[at : m.start()]), self.t.unguard("".join(self.mask)))
                at, self.mask = m.end(), []
        self.held = [whole[at:]] if at < len(whole) else []

    def parse(self, turn: str) -> tuple[str, str]:
        for role, head in self.t.headers.items():
            if turn.startswith(head):
                return role, self.t.unguard(turn[len(head) :])
        if not turn.startswith(self.t.other):
            raise ValueError("a turn begins with no header of the template")
        body = turn[len(self.t.other) :]
        colon = next(m for m in self.colon.finditer(body) if m[1])
        return self.t.unguard(body[: colon.start()]), self.t.unguard(body[colon.end() :])


def read_chats(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parse formatted conversations and digest what they hold: a row of READ for each."""
    template = template or ChatTemplate()
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            last, open_ = object(), False
            for batch in batches:
                for conv, turn, text, loss, allowed in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "segment", "loss", "allowed")), strict=True):
                    if conv != last:
                        if open_:
                            yield last, n, turns.hexdigest(), chars, losses.hexdigest(), size, bad, state in template.final
                        last, open_, n, chars, size, bad, seen, state = conv, True, 0, 0, 0, 0, None, template.start
                        turns, losses, reader = hashlib.sha256(), hashlib.sha256(), TurnReader(template)
                    size += len(text)
                    bad += turn != seen and not allowed
                    seen = turn
                    for role, said, under in reader.feed(text, loss):
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode())
                        losses.update(under.encode())
                        chars += len(under)
                        state, _ = template.step(state, role)
            if open_:
                yield last, n, turns.hexdigest(), chars, losses.hexdigest(), size, bad, state in template.final

        yield from _batches(conversations(), READ)

    return rows.mapInArrow(run, READ)
