"""Streams whose rows come in any order, and conversations guarded as their turns arrive.

Both keep their state by key with ``transformWithState``, so the session needs the RocksDB state store
(``stateful`` sets it).  State grows with what is held back, never with what was given out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from guardframe.functions.detect import DetectOptions, categories, detect_columns
from guardframe.functions.errors import injection_error, leak_error
from guardframe.functions.leak import LeakOptions, leak_columns
from guardframe.operators.conversations import GuardOptions
from guardframe.operators.messages import text_of
from guardframe.streaming.chunks import CHUNK, FOREVER_MS, OVERLAP, border

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """The session, its streams on the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def units(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


class Chunker(StatefulProcessor):
    """Chunks of one stream: deltas wait until all before them are there."""

    def __init__(self, size: int, overlap: int, timeout_ms: int, first_seq: int):
        self.size, self.overlap, self.timeout_ms, self.first_seq = size, overlap, timeout_ms, first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what is held of the text begins at UTF-16 unit ``start``; ``number`` is that of the next chunk
        self.place = handle.getValueState("place", "start long, held long, number int, seq long, due long")
        self.pieces = handle.getListState("pieces", "piece string")
        self.waiting = handle.getMapState("waiting", "seq long", "delta string, is_end boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, held, number, seq, due = self.place.get() if self.place.exists() else (0, 0, 0, self.first_seq, 0)
        came: dict[int, tuple] = {}
        for frame in rows:
            for at, delta, is_end in zip(frame["seq"], frame["delta"], frame["is_end"], strict=True):
                if pd.isna(at):
                    raise ValueError(f"stream {key[0]}: a delta without seq")
                if at >= seq:  # what came before is given out or held: a repeated row
                    came.setdefault(int(at), (None if pd.isna(delta) else delta, not pd.isna(is_end) and bool(is_end)))
        new, ended = [], False
        while not ended and (seq in came or self.waiting.containsKey((seq,))):
            delta, ended = came.pop(seq) if seq in came else self.waiting.getValue((seq,))
            self.waiting.removeKey((seq,))
            new.append(delta or "")
            seq += 1
        text, out = "".join(new), []
        if text:
            self.pieces.appendValue((text,))
            held += units(text)
        if ended or (self.size and start + held >= (number + 1) * self.size):
            raw = self.held_text()
            while self.size and start + len(raw) // 2 >= (number + 1) * self.size:
                out += self.piece(key, raw, start, number, (number + 1) * self.size)
                number += 1
                keep = border(raw, start, max(0, number * self.size - max(self.overlap, 1)))
                raw, start = raw[2 * (keep - start) :], keep
            held = len(raw) // 2
            if ended:
                out += self.piece(key, raw, start, number, start + held)
            else:
                self.pieces.put([(raw.decode("utf-16-le"),)])
        if due:
            self.handle.deleteTimer(due)
        if ended:
            self.forget()
        else:
            for at, row in came.items():
                self.waiting.updateValue((at,), row)
            due = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(due)
            self.place.update((start, held, number, seq, due))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        start, _, number, _, _ = self.place.get()
        late = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        raw, out = self.held_text() + "".join(delta or "" for _, delta in late).encode("utf-16-le"), []
        while self.size and start + len(raw) // 2 > (number + 1) * self.size:
            out += self.piece(key, raw, start, number, (number + 1) * self.size, True)
            number += 1
        self.forget()
        yield self.frame(out + self.piece(key, raw, start, number, start + len(raw) // 2, True))

    def held_text(self) -> bytes:
        return "".join(p[0] for p in self.pieces.get()).encode("utf-16-le") if self.pieces.exists() else b""

    def piece(self, key, raw: bytes, start: int, number: int, end: int, timed_out: bool = False) -> list[tuple]:
        begin, end = border(raw, start, max(0, number * self.size - self.overlap)), border(raw, start, end)
        if border(raw, start, number * self.size) >= end:
            return []
        return [(key[0], number, raw[2 * (begin - start) : 2 * (end - start)].decode("utf-16-le"), timed_out)]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["stream_id", "chunk_no", "chunk", "timed_out"])

    def forget(self) -> None:
        for state in (self.place, self.pieces, self.waiting):
            state.clear()

    def close(self) -> None:
        pass


def ordered_chunks(deltas: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, timeout_ms: int = FOREVER_MS, first_seq: int = 0) -> DataFrame:
    """The streaming form of ``chunked`` for deltas (stream_id, seq, delta, is_end) in any order.

    ``seq`` counts up by one from ``first_seq``.  A delta waits until all before it are there, over any number of
    micro-batches; one that comes again is left out.  Buffered text is a list that grows by pieces and is read only where
    a chunk is full.  ``size`` 0 buffers until the end of the stream.  What a stream without an end, or with a gap,
    still holds ``timeout_ms`` after its last row is given out, in order of seq, with ``timed_out`` true.  Null
    deltas are empty, a null seq fails the query.  Rows of an ended stream that come again begin it anew.
    """
    kind = dict(deltas.dtypes)["stream_id"]
    rows = deltas.select("stream_id", F.col("seq").cast("long").alias("seq"), "delta", "is_end")
    made = f"stream_id {kind}, chunk_no int, chunk string, timed_out boolean"
    return rows.groupBy("stream_id").transformWithStateInPandas(Chunker(size, overlap, timeout_ms, first_seq), made, "Append", "ProcessingTime")


class Warden(StatefulProcessor):
    """First system prompt and first detected turn of one conversation, told to each turn as it arrives."""

    def __init__(self, columns: list[str], block: bool):
        self.columns, self.block = columns, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "asked boolean, prompt string, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, prompt, error = self.known.get() if self.known.exists() else (False, None, None)
        # one micro-batch of one conversation: its turns may be dealt over several frames
        frame = pd.concat(list(rows)).sort_values("turn", kind="stable")
        prompts, blocked, errors = [], [], []
        for role, said, own in zip(frame["role"], frame["said"], frame["error"], strict=True):
            if role == "system" and not asked:
                asked, prompt = True, said or None
            own = None if pd.isna(own) else own
            error = error or own
            prompts.append(prompt)
            blocked.append(self.block and error is not None)
            errors.append(error if self.block else own)
        self.known.update((asked, prompt, error))
        yield frame.assign(prompt=prompts, blocked=blocked, error=errors)[self.columns]

    def close(self) -> None:
        pass


def guarded_turns(turns: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text and maybe parts) of a stream as they arrive: conv_id, turn, role, text, blocked, error,
    leaked, output and leak_message.

    From the first detected user turn on, ``blocked`` is true and ``error`` tells why; take the others with
    ``NOT blocked``.  With ``warn`` nothing is blocked and ``error`` stands at each detected turn.  ``output`` is the text, of
    assistants sanitized against the first system message that the conversation had by then; null where ``throw_on_leak``
    is set and it leaks, and where the turn is blocked.  Detection comes before the state and sanitizing after it, so
    both run as in batch; the state is a prompt and an error for each conversation.  Turns are judged in order of
    turn within a micro-batch, and in order of arrival over several: what was given out is not taken back.
    A null role or text says nothing.  Conversations have no end, so their state stays.
    """
    o = options or GuardOptions()
    if o.source == "ai-sdk-auto":
        raise ValueError("ai-sdk-auto scans parts: use verdicts and guarded_outputs")
    rows = turns.select("conv_id", "turn", "role", text_of(turns).alias("text"))
    rows = rows.withColumns({"said": F.lit(o.system_prompt) if o.system_prompt is not None else F.when(F.col("role") == "system", F.col("text")), "error": F.lit(None).cast("string")})
    if o.detect is not False:
        rows = rows.withColumn("asked", F.when(F.col("role") == "user", F.col("text")))
        rows = detect_columns(rows, "asked", o.detect if isinstance(o.detect, DetectOptions) else DetectOptions())
        found = F.col("detection")
        rows = rows.withColumn("error", F.when(found["detected"], injection_error(found["risk"], categories(found))["message"])).drop("asked", "detection")
    kinds = dict(rows.dtypes)
    columns = ["conv_id", "turn", "role", "text", "prompt", "blocked", "error"]
    made = ", ".join(f"{c} {({'prompt': 'string', 'blocked': 'boolean'} | kinds)[c]}" for c in columns)
    told = rows.groupBy("conv_id").transformWithStateInPandas(Warden(columns, o.on_detection == "block"), made, "Append", "None")
    prompt = F.lit(o.system_prompt) if o.system_prompt is not None else F.concat("prompt", F.lit(""))
    told = told.withColumns({"prompt": prompt, "blocked": F.col("blocked"), "checked": F.when((F.col("role") == "assistant") & ~F.col("blocked"), F.concat("text", F.lit("")))})
    if o.sanitize is False or (o.source == "ai-sdk" and o.system_prompt is None):
        told = told.withColumn("checked", F.lit(None).cast("string"))
    told = leak_columns(told, "checked", "prompt", o.sanitize if isinstance(o.sanitize, LeakOptions) else LeakOptions())
    leak = F.col("leak")
    instead = F.lit(None).cast("string") if o.throw_on_leak else leak["sanitized"]
    output = F.when(F.col("blocked"), F.lit(None)).when(leak["leaked"], instead).otherwise(F.col("text"))
    message = F.when(leak["leaked"], leak_error(leak["confidence"], F.size(leak["fragments"]))["message"])
    return told.select("conv_id", "turn", "role", "text", "blocked", "error", leak["leaked"].alias("leaked"), output.alias("output"), message.alias("leak_message"))
