"""Streams of text deltas: buffered, chunked with overlap, or passed through.

The batch forms are closed expressions.  The Structured Streaming form keeps what is not yet given out
in the state store, ends a stream at its ``is_end`` row, and gives out the rest of forgotten streams after
a timeout, marked so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardframe.functions.errors import leak_error
from guardframe.functions.leak import LeakOptions, leak_columns, leaks_found, prompt_columns
from guardframe.functions.text import inner, utf16_pieces, utf16_prefix, utf16_substring

EMIT = 64
OVERLAP = 64
CHUNK = 8192
FOREVER_MS = 24 * 3600 * 1000


def buffered(deltas: DataFrame) -> DataFrame:
    """stream_id, text: all deltas joined in order of seq."""
    pieces = F.sort_array(F.collect_list(F.struct("seq", "delta")))
    return deltas.groupBy("stream_id").agg(F.array_join(F.transform(pieces, lambda p: F.coalesce(p["delta"], F.lit(""))), "").alias("text"))


def cut(df: DataFrame, text_col: str, size: int, overlap: int, number: str, piece: str, before: str | None = None) -> DataFrame:
    name = inner(df)("pieces")
    rows = df.withColumn(name, F.explode(utf16_pieces(f"`{text_col}`", size, overlap)))
    return rows.withColumns({number: F.col(name)["no"], piece: F.col(name)["piece"]} | ({before: F.col(name)["before"]} if before else {})).drop(name)


def chunk_string(df: DataFrame, text_col: str = "text", size: int = EMIT) -> DataFrame:
    """``df`` with a row for each piece of ``size`` UTF-16 units: piece_no, piece.  Surrogate pairs stay whole."""
    return cut(df, text_col, size, 0, "piece_no", "piece")


def chunked(df: DataFrame, text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with a row for each chunk of ``size`` UTF-16 units: chunk_no and chunk, the end of what came before in front."""
    return cut(df, text_col, size, overlap, "chunk_no", "chunk")


def sanitized_chunks(df: DataFrame, prompt_col: str, text_col: str = "text", size: int = CHUNK, options: LeakOptions | None = None, dedupe_overlap: bool = False) -> DataFrame:
    """Chunks with ``leaked`` and ``output``.  Overlaps are given out twice, unless told otherwise.

    What is worked out of a prompt is so once for a text, before it is cut.
    """
    o, working = options or LeakOptions(), inner(df)
    name, before = working("leak"), working("before")
    rows = cut(prompt_columns(df, prompt_col, o, working), text_col, size, OVERLAP, "chunk_no", "chunk", before)
    rows = leaks_found(rows, utf16_prefix(F.col("chunk"), o.max_output_length), o, working, name)
    leak = F.col(name)
    output = F.when(leak["leaked"], leak["sanitized"]).otherwise(F.col("chunk"))
    if dedupe_overlap:
        output = F.when(leak["leaked"] | (F.col(before) == 0), output).otherwise(utf16_substring(output, F.col(before), F.lit(1 << 28)))
    return rows.withColumns({"leaked": leak["leaked"], "output": output}).drop(name, before)


def passed(deltas: DataFrame) -> DataFrame:
    """Deltas with text as they are: stream_id, seq, piece.  Nothing is held or sanitized; batch or streaming."""
    return deltas.filter("delta IS NOT NULL AND delta <> ''").select("stream_id", "seq", F.col("delta").alias("piece"))


def chunk_report(chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, leaks, leak_message of each stream with a leaking chunk (rows with ``leaked``).

    Chunks are given out before it is known whether a later one leaks, so the error stands at the end of the
    stream and tells neither confidence nor fragments: 1 and 0.
    """
    hit = chunks.groupBy(key).agg(F.count_if("leaked").alias("leaks")).filter("leaks > 0")
    return hit.select(key, "leaks", leak_error(F.lit(1.0), F.lit(0))["message"].alias("leak_message"))


def border(raw: bytes, start: int, at: int) -> int:
    """UTF-16 unit ``at`` (``raw`` begins at ``start``), or the one before it where it would part a pair."""
    place = 2 * (at - start)
    return at - (1 if 2 <= place < len(raw) and 0xD8 <= raw[place - 1] <= 0xDB else 0)


def stream_chunks(deltas: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, timeout_ms: int = FOREVER_MS) -> DataFrame:
    """The streaming form of ``chunked``: deltas (stream_id, seq, delta, is_end) to stream_id, chunk_no, chunk, timed_out.

    Deltas of a stream must arrive in order of seq over micro-batches, else the query fails; within one
    they are sorted.  ``size`` 0 buffers until the end of the stream.  What a stream without an end still holds
    after the timeout is given out with ``timed_out`` true; what comes later begins a stream anew.

    Run with the trigger ``availableNow``, such a query only stops where the session has
    spark.sql.streaming.noDataMicroBatches.enabled set to false: else empty batches go on waiting for timeouts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # what is kept of the text begins at UTF-16 unit ``start``; ``number`` is that of the next chunk
        kept, start, number, last = state.get if state.exists else ("", 0, 0, None)
        out: list[tuple] = []

        def give(raw: bytes, end: int, timed_out: bool = False) -> None:
            begin, end = border(raw, start, max(0, number * size - overlap)), border(raw, start, end)
            if border(raw, start, number * size) < end:
                out.append((key[0], number, raw[2 * (begin - start) : 2 * (end - start)].decode("utf-16-le"), timed_out))

        raw = kept.encode("utf-16-le")
        if state.hasTimedOut:
            state.remove()
            give(raw, start + len(raw) // 2, True)
        else:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            if last is not None and int(rows["seq"].iloc[0]) < last:
                raise ValueError(f"stream {key[0]}: seq {rows['seq'].iloc[0]} comes after {last}")
            raw += "".join(rows["delta"].dropna()).encode("utf-16-le")
            while size and start + len(raw) // 2 >= (number + 1) * size:
                give(raw, (number + 1) * size)
                number += 1
                keep = border(raw, start, max(0, number * size - max(overlap, 1)))
                raw, start = raw[2 * (keep - start) :], keep
            if bool(rows["is_end"].fillna(False).any()):
                give(raw, start + len(raw) // 2)
                state.remove()
            else:
                state.update((raw.decode("utf-16-le"), start, number, int(rows["seq"].iloc[-1])))
                state.setTimeoutDuration(timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["stream_id", "chunk_no", "chunk", "timed_out"]
    kind = dict(deltas.dtypes)["stream_id"]
    return deltas.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, chunk_no int, chunk string, timed_out boolean", "kept string, start long, number int, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sanitized_stream(deltas: DataFrame, prompts: DataFrame, size: int = CHUNK, options: LeakOptions | None = None) -> DataFrame:
    """Streamed chunks, each sanitized against its stream's prompt (stream_id, system_prompt)."""
    # a projection between: rows that come from Python can't be shuffled or joined as they are (Spark 4.1)
    made = stream_chunks(deltas, size).withColumn("chunk", F.concat("chunk", F.lit("")))
    both = made.join(prompts, "stream_id", "left")
    rows = leak_columns(both, "chunk", "system_prompt", options, "_gf_leak")
    leak = F.col("_gf_leak")
    return rows.select("stream_id", "chunk_no", leak["leaked"].alias("leaked"), F.when(leak["leaked"], leak["sanitized"]).otherwise(F.col("chunk")).alias("output"), "timed_out")
