"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier.

The corpus is cut so that equal strings meet, without sending all of it around:

1. Of the hashes of all ``SEED``-byte strings in a window of LENGTH bytes the least is the window's
   anchor.  Equal windows have equal anchors at equal places.  An anchor owns the windows that chose
   it; their bytes are its context (``LENGTH`` to about twice that).
2. Anchors meet by hash.  An anchor that occurs once owns no repeated window.  Of equal contexts all
   but the first repeat entirely.  Only the first of each *different* context of an anchor is open.
   Tasks leave out what repeats within a block before anything is shuffled.
3. The bytes of open contexts are fetched and indexed together with those of the same anchor: a suffix
   array and the Burrows-Wheeler transform's links to the suffix one byte further.  The set of
   neighbours in the array that share fewer than n bytes is turned into that for n + 1 by one step of
   backward extension, breadth first over the whole array; the steps begin at one byte and stop at LENGTH.
   What is not separated then are the intervals of equal windows; all but the first window of each are
   repeated.

An anchor with more than ``CROWD`` different contexts isn't indexed in one piece: its windows are dealt
out one by one, by their own hash, and a window's bytes tell whether it came before.  The most common
anchors, as a sample of the documents shows them, are treated so from the start and dealt by context, so
their rows don't meet in one task.  Which anchors these are doesn't change what is removed.

Defined cases: null and empty texts have no bytes and nothing is removed; matches never cross rows;
repeated rows or ids and null ids are documents one after another, by id (nulls first), a hash of the text, text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from guardframe.llm.common import blocks, discard, few, map_arrow, materialize, row_key
from guardframe.llm.words import ODD, Ranges, mix, texts_of

LENGTH = 100
SEED = 48
CROWD = 5_000
CHUNK = 1 << 20  # bytes indexed at once
COMMON, PART = 2000, 16  # anchors dealt by context at most, found in one of so many documents
LOW = np.uint64((1 << 24) - 1)  # low bits of a hash, in which the place within a piece of 2**24 is packed


def longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


def least_places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of each ``size`` neighbours by the hash's high bits, leftmost among equals.

    The place is packed into the low bits, counted from the start of a piece; pieces overlap so far that
    each run of neighbours lies in one of them.
    """
    step = int(LOW) + 2 - size
    out = [np.empty(0, np.int64)]
    for at in range(0, len(hashes) - size + 1, step):
        part = hashes[at : at + step + size - 1]
        least = sliding_least((part & ~LOW) | np.arange(len(part), dtype=np.uint64), size)
        out.append((least & LOW).astype(np.int64) + at)
    return np.concatenate(out)


def seeds(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` (a multiple of 8) bytes, of whole words of 8 at a time."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
    n = len(raw) - size + 1
    out = np.full(n, SEED, np.uint64)
    for at in range(0, size, 8):
        out ^= words[at : at + n]
        out *= ODD
        out ^= out >> np.uint64(32)
    return out


def anchors(column: pa.Array, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Anchors of the texts: row, anchor hash, context hash, first owned window, owned windows."""
    raw, at = texts_of(column)
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return {"row": none, "anchor": none, "context": none, "start": none, "windows": none}
    hashes = seeds(raw, seed)
    chosen = least_places(hashes, length - seed + 1)
    inside = np.zeros(len(raw) + 1, np.int32)  # window starts whose window stays in one text
    full = np.flatnonzero(np.diff(at) >= length)
    np.add.at(inside, at[full], 1)
    np.add.at(inside, at[full + 1] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1])[: len(chosen)] > 0)
    anchor = chosen[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    start = window[first]
    count = np.diff(np.append(first, len(window)))
    row = np.searchsorted(at, start, side="right") - 1
    # the anchor's place in its window tells apart equal contexts that own different windows
    context = mix(Ranges(raw)(start, start + count + length - 1) ^ (anchor[first] - start).astype(np.uint64))
    return {"row": row, "anchor": hashes[anchor[first]].view(np.int64), "context": context.view(np.int64), "start": start - at[row], "windows": count}


def find_anchors(docs: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """key, anchor, context, start, windows, salt and state for all anchors of docs (key, text).

    ``state`` 0: an equal context is earlier in the same block, so all its windows repeat; 1: to be compared;
    2: of a common anchor.  Rows are dealt by (anchor, salt).
    """
    common = np.empty(0, np.int64) if common is None else common

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, "text", 2 << 20):
            a = anchors(part.column("text"))
            key = part.column("key").to_numpy()[a["row"]]
            order = np.lexsort((a["start"], key, a["context"], a["anchor"]))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (a["anchor"][order[1:]] == a["anchor"][order[:-1]]) & (a["context"][order[1:]] == a["context"][order[:-1]])
            hot = np.isin(a["anchor"], common)
            yield {"key": key, **{c: a[c] for c in ("anchor", "context", "start", "windows")}, "salt": np.where(again, key, np.where(hot, a["context"], 0)), "state": np.where(again, 0, np.where(hot, 2, 1))}

    ints = [T.StructField(c, T.IntegerType()) for c in ("start", "windows", "state")]
    return map_arrow(docs, run, T.StructType([*longs("key", "anchor", "context", "salt"), *ints]))


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors that would be crowded, the most common first, as one of ``PART`` documents shows them."""
    some = find_anchors(docs.filter(F.pmod(F.xxhash64("key"), F.lit(PART)) == 0))
    counts = some.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") * PART > CROWD)
    return np.array([r["anchor"] for r in counts.orderBy(F.desc("n"), "anchor").limit(COMMON).collect()], np.int64)


def sift(found: DataFrame) -> DataFrame:
    """Repeated anchors: ``state`` 0: all windows repeat earlier ones; 1: open; 2: open, and crowded.

    Rows arrive sorted by (anchor, salt, context, key, start), so a task streams; it holds at most a batch
    and the ``CROWD`` first contexts of one anchor.
    """
    rows = found.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "context", "key", "start")
    schema = T.StructType([*longs("key", "anchor"), T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("state", T.IntegerType())])
    names = ["key", "anchor", "start", "windows"]

    def out(columns: list[np.ndarray], state: int) -> pa.RecordBatch:
        made = [*columns, np.full(len(columns[0]), state, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("key", "anchor") else pa.int32()) for n, c in zip(schema.names, made, strict=True)], names=schema.names)

    def run(batches):
        last = None  # anchor, salt, context of the last row
        held: list[list] = []  # first rows of the contexts of the last anchor
        size, total = 0, 0  # contexts held; rows of that anchor

        def close():
            """What the last anchor leaves open: nothing unless it has two contexts."""
            if size > 1:
                return [out([np.concatenate(c) for c in zip(*held, strict=True)], 1)]
            return []

        for batch in batches:
            state = batch.column("state").to_numpy()
            columns = [batch.column(n).to_numpy() for n in names]
            if (state == 0).any():
                yield out([c[state == 0] for c in columns], 0)
            anchor, salt, context, state, *columns = (c[state > 0] for c in (*(batch.column(n).to_numpy() for n in ("anchor", "salt", "context")), state, *columns))
            if not len(anchor):
                continue
            new_anchor, new_context = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
            new_anchor[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
            new_context[1:] = new_anchor[1:] | (context[1:] != context[:-1])
            if last is not None:
                new_anchor[0] = anchor[0] != last[0] or salt[0] != last[1]
                new_context[0] = new_anchor[0] or context[0] != last[2]
            again = ~new_context
            if again.any():
                yield out([c[again] for c in columns], 0)
            dealt = new_context & (state == 2)  # of a common anchor
            if dealt.any():
                yield out([c[dealt] for c in columns], 2)
                new_context &= ~dealt
            # anchors that begin and end in this batch, all at once
            begin = np.flatnonzero(new_anchor)
            group = np.cumsum(new_anchor)  # 0: goes on from before
            firsts = np.bincount(group, weights=new_context, minlength=len(begin) + 1).astype(np.int64)
            middle = new_context & (group > 0) & (group < len(begin)) & (firsts[group] > 1) & (firsts[group] <= CROWD)
            before = new_context & (group == 0)
            if before.any():
                rows = [c[before] for c in columns]
                if size <= CROWD < size + len(rows[0]):
                    if held:
                        yield out([np.concatenate(c) for c in zip(*held, strict=True)], 2)
                    held = []
                size += len(rows[0])
                if size > CROWD:
                    yield out(rows, 2)
                else:
                    held.append(rows)
            if len(begin):
                if size <= CROWD:
                    yield from close()
                if middle.any():
                    yield out([c[middle] for c in columns], 1)
                wide = new_context & (group > 0) & (group < len(begin)) & (firsts[group] > CROWD)
                if wide.any():
                    yield out([c[wide] for c in columns], 2)
                tail = new_context & (group == len(begin))
                rows = [c[tail] for c in columns]
                size, held = len(rows[0]), [rows]
                if size > CROWD:
                    yield out(rows, 2)
                    held = []
            last = (anchor[-1], salt[-1], context[-1])
        if size <= CROWD:
            yield from close()

    return rows.mapInArrow(run, schema)


def open_contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """deal, key, start, bytes, kind: open contexts, dealt by anchor (``kind`` 1) or, if crowded, window by
    window (2); windows that an equal one of the same batch precedes come without bytes (0)."""
    lists = materialize(asked.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor", "state")).alias("asked")), "asked")
    both = docs.join(few(lists.select("key")), "key", "left_semi").join(lists, "key")
    ints = [T.StructField(c, T.IntegerType()) for c in ("start", "kind")]
    schema = T.StructType([*longs("deal", "key"), *ints, T.StructField("bytes", T.BinaryType())])

    def run(batch: pa.RecordBatch):
        rows: list[tuple] = []
        windows: dict[bytes, tuple] = {}  # the first of each window so far

        def full() -> dict:
            made = [*rows, *((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), k, s, 2, w) for w, (k, s) in windows.items())]
            rows.clear()
            windows.clear()
            return dict(zip(("deal", "key", "start", "kind", "bytes"), zip(*made, strict=True), strict=True))

        for k, text, contexts in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            raw = text.encode()
            for r in contexts:
                a, n = r["start"], r["windows"]
                if r["state"] == 1:
                    rows.append((r["anchor"], k, a, 1, raw[a : a + n + LENGTH - 1]))
                    continue
                for s in range(a, a + n):
                    window = raw[s : s + LENGTH]
                    first = windows.setdefault(window, (k, s))
                    if first != (k, s):
                        windows[window] = min(first, (k, s))
                        late = max(first, (k, s))
                        rows.append((late[0], late[0], late[1], 0, None))
                if len(rows) + len(windows) > 20_000:
                    yield full()
        if rows or windows:
            yield full()

    return map_arrow(both, run, schema)


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes by their first ``depth`` bytes (or more).

    Ranks by 8 bytes first, then by twice as many at a time.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(raw)]
    key = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        now = key[order]
        rank = np.empty(len(raw), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], now[1:] != now[:-1]]))
        after = np.zeros(len(raw), np.int64)
        after[:-width] = rank[width:] + 1
        key = ((rank << 32) | after).astype(np.uint64)
        width *= 2


def separated(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each place of it whether it shares less than ``length`` bytes with the
    place before.

    For one byte the first bytes tell it.  If neighbours begin with the same byte, they share n + 1 bytes
    just where the suffixes one byte further on share n; these are reached by the links of the transform,
    and share n where no border below n lies between them.  So each round extends all intervals backward
    by a byte, and the common prefixes get known by increasing length.
    """
    n = len(raw)
    order = suffix_array(raw, length)
    place = np.empty(n + 1, np.int32)
    place[order] = np.arange(n)
    place[n] = -1
    apart = np.ones(n, bool)
    first = raw[order]
    apart[1:] = first[1:] != first[:-1]
    here = np.flatnonzero(~apart).astype(np.int32)
    x, y = place[order[here - 1] + 1], place[order[here] + 1]
    lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
    sums = np.zeros(n + 1, np.int32)
    for _ in range(length - 1):
        np.cumsum(apart, out=sums[1:])
        cut = sums[hi] != sums[lo]
        if cut.any():
            apart[here[cut]] = True
            keep = ~cut
            here, lo, hi = here[keep], lo[keep], hi[keep]
    return order, apart


def repeats(key: np.ndarray, start: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (key, first, last) of windows that occur earlier in another of the contexts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # no byte of UTF-8
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    order, apart = separated(raw, length)
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    window = np.full(len(raw), -1, np.int64)
    window[begin[owner] + offset] = np.arange(len(owner))
    when = np.empty(len(owner), np.int64)  # windows by (key, place)
    when[np.lexsort((start[owner] + offset, key[owner]))] = np.arange(len(owner))
    interval = np.cumsum(apart)
    at = window[order]
    at, interval = at[at >= 0], interval[window[order] >= 0]
    border = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])) if len(at) else np.empty(0, np.int64)
    least = np.minimum.reduceat(when[at], border) if len(at) else border
    late = np.zeros(len(owner), bool)
    late[at] = when[at] != np.repeat(least, np.diff(np.append(border, len(at))))
    hit = np.flatnonzero(late)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    return key[owner[first]], start[owner[first]] + offset[first], start[owner[last]] + offset[last]


def index(contexts: DataFrame) -> DataFrame:
    """key, first, last: ranges of repeated windows among open contexts, indexed deal by deal.

    A task holds about ``CHUNK`` bytes of contexts and those of one deal more, ``CROWD`` at most.  Of
    windows dealt one by one only the first of the last deal is held.
    """
    rows = contexts.repartition("deal").sortWithinPartitions("deal", "key", "start")
    schema = T.StructType([*longs("key"), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def out(key, first, last):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=schema.names)

    def close(parts):
        return out(*repeats(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64), [t for p in parts for t in p[3]]))

    def run(batches):
        held, size = [], 0
        seen: set[bytes] = set()  # different windows of the last deal: more than one if their hashes collide
        last = None

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (none := kind == 0).any():
                key, start = (batch.column(c).to_numpy()[none] for c in ("key", "start"))
                yield out(key, start, start)
            if (one := kind == 2).any():
                late = []
                picked = batch.filter(pa.array(one))
                deal, key, start = (picked.column(c).to_numpy() for c in ("deal", "key", "start"))
                for i, (d, window) in enumerate(zip(deal.tolist(), picked.column("bytes").to_pylist(), strict=True)):
                    if d != last:
                        last, seen = d, {window}
                    elif window in seen:
                        late.append(i)
                    else:
                        seen.add(window)
                yield out(key[late], start[late], start[late])
            batch = batch.filter(pa.array(kind == 1))
            deal, key, start = (batch.column(c).to_numpy() for c in ("deal", "key", "start"))
            data = batch.column("bytes").to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(deal[1:] != deal[:-1]) + 1, [len(deal)]]) if len(deal) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and size >= CHUNK and held[-1][0] != deal[a]:
                    yield close(held)
                    held, size = [], 0
                held.append((deal[a], key[a:b], start[a:b], data[a:b]))
                size += sum(map(len, data[a:b]))
        if held:
            yield close(held)

    return rows.mapInArrow(run, schema)


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``spans``: maximal runs (start, end in bytes) that repeated windows cover."""
    docs, key = row_key(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id")
    docs = docs.select("doc_id", "text", F.col(key).alias("key"))
    texts = docs.select("key", "text")
    sifted = materialize(sift(find_anchors(texts, common_anchors(texts))), "anchors")
    contexts = open_contexts(texts, sifted.filter("state > 0"))
    opened = materialize(index(contexts), "repeats")
    whole = sifted.filter("state = 0").select("key", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last"))
    ranges = whole.unionByName(opened).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    ranges = materialize(ranges, "ranges")
    discard(sifted, opened)
    schema = T.StructType([*longs("key"), T.StructField("spans", T.ArrayType(T.StructType.fromDDL("start int, end int")))])

    def run(batch: pa.RecordBatch):
        lists = batch.column("ranges")
        at, flat = np.asarray(lists.offsets), lists.values
        first, last = np.asarray(flat.field("first")), np.asarray(flat.field("last")) + LENGTH
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            f, e = first[a:b], np.maximum.accumulate(last[a:b])
            new = np.ones(len(f), bool)
            new[1:] = f[1:] > e[:-1]
            ends = e[np.append(np.flatnonzero(new)[1:] - 1, len(f) - 1)]
            out.append([{"start": int(x), "end": int(y)} for x, y in zip(f[new], ends, strict=True)])
        yield {"key": batch.column("key"), "spans": out}

    joined = map_arrow(ranges, run, schema)
    spans = materialize(joined, "spans")
    discard(ranges)
    return docs.join(spans, "key", "left").select("doc_id", "text", "spans")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay), in one pass over each text."""
    schema = T.StructType([found.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string")])

    def run(batch: pa.RecordBatch):
        size, removed, count, digest = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw, at, gone, kept = memoryview(text.as_buffer() or b""), 0, 0, hashlib.sha256()
            for s in spans or ():
                kept.update(raw[at : s["start"]])
                at, gone = s["end"], gone + s["end"] - s["start"]
            kept.update(raw[at:])
            size.append(len(raw))
            removed.append(gone)
            count.append(len(spans or ()))
            digest.append(kept.hexdigest())
        yield {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_removed": removed, "n_spans": count, "kept_sha256": digest}

    return map_arrow(found.select("doc_id", "text", "spans"), run, schema)
