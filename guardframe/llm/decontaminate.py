"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the words of all normalised test items.  Documents stream through it word by
word; at each word the length of the longest match that ends there is known.  Where it reaches
``window`` words (or a whole shorter item) the words are hit.  ``clean`` removes hit spans and drops
documents of which more than ``coverage`` is hit.

Items are dealt into shards of about ``SHARD_WORDS`` words by a hash; longer items are cut into pieces
that overlap by a window.  Each shard's automaton is made by one task and stored in the shared folder as
flat arrays, about 60 bytes for each word.  The tasks over documents take one shard after another for
each block, so no automaton passes the driver and memory doesn't grow with the benchmark.  Within a
block all runs of known words go through the automaton together, a word at a time.

Defined cases: a null text has no words and no hits; items without words match nothing; items of
fewer words than the window match as a whole; repeated items and item ids count once; items without an id
make hits but aren't listed; repeated or null document ids are rows like others; empty tables give no rows
or no hits; other columns are kept.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from guardframe.llm.common import blocks, free_name, kept_by, map_arrow, materialize, new_path

WINDOW = 10
SHARD_WORDS = 100_000  # 80 MB while an automaton is made, 6 MB as arrays
RUN = 256  # words of a run that are streamed in one piece
BLOCK_BYTES = 2 << 20
#: A-Z to small letters; everything in ASCII that is no digit or letter ends a word.
NORMAL = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


class Maker:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.next, self.link, self.len = [{}], [-1], [0]
        seen: list[tuple[int, int]] = []
        short: list[tuple[int, int, int]] = []
        self.least, self.names = window, [item for item, _ in items]
        for number, (_, said) in enumerate(items):
            last = 0
            for w in said:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                seen.append((last, number))
            if 0 < len(said) < window:
                short.append((last, len(said), number))
                self.least = min(self.least, len(said))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.top = [-1] * len(self.len)  # the state of the last ``window`` words, where so many match
        for v in order:
            if self.len[v] >= window:
                up = self.link[v]
                self.top[v] = self.top[up] if self.len[up] >= window else v
        self.items: dict[int, set] = {}
        for v, number in seen:
            if self.top[v] >= 0:
                self.items.setdefault(self.top[v], set()).add(number)
        own: dict[int, set] = {}
        for v, n, number in short:
            own.setdefault(v, set()).add((n, number))
        self.short: dict[int, tuple] = {}  # whole short items that end where a state ends
        for v in order if own else ():
            if here := tuple(own.get(v, ())) + self.short.get(self.link[v], ()):
                self.short[v] = here

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item begins alike
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
        return new

    def stored(self) -> bytes:
        """All of it as flat arrays; moves are sorted by state and word."""
        size = len(self.vocab)
        moves = sorted((v * size + w, to) for v, out in enumerate(self.next) for w, to in out.items())
        whole = sorted((v, number) for v, numbers in self.items.items() for number in numbers)
        short = sorted((v, n, number) for v, found in self.short.items() for n, number in found)
        out = io.BytesIO()
        np.savez(out, key=np.array([k for k, _ in moves], np.int64), to=np.array([t for _, t in moves], np.int32), link=np.array(self.link, np.int32), len=np.array(self.len, np.int32),
                 top=np.array(self.top, np.int32), whole=np.array(whole, np.int64).reshape(-1, 2), short=np.array(short, np.int64).reshape(-1, 3), least=np.array(self.least),
                 vocab=np.frombuffer(b" ".join(self.vocab), np.uint8), names=np.frombuffer(json.dumps(self.names).encode(), np.uint8))
        return out.getvalue()


class Automaton:
    """The arrays of a stored automaton."""

    def __init__(self, raw: bytes, window: int):
        held = np.load(io.BytesIO(raw))
        self.window, self.least = window, int(held["least"])
        self.key, self.to, self.link, self.len, self.top = (held[c] for c in ("key", "to", "link", "len", "top"))
        self.whole, self.short = held["whole"], held["short"]
        self.vocab = {w: i for i, w in enumerate(held["vocab"].tobytes().split(b" ") if len(held["vocab"]) else ())}
        self.names = json.loads(held["names"].tobytes())

    def match(self, said: list[bytes], at: np.ndarray, cover: np.ndarray) -> np.ndarray:
        """Marks hit words in ``cover`` (a difference array); (document, item number) of each item found.

        ``said``: words of all documents, ``at``: the place of each one's first word, and the end.
        """
        known = np.zeros(len(said) + 2, bool)
        ids = np.fromiter(map(self.vocab.get, said, repeat(-1)), np.int64, len(said))
        known[1:-1] = ids >= 0
        edge = np.flatnonzero(known[1:] != known[:-1])
        border = np.unique(at[1:-1])
        border = border[(border > 0) & (border < len(said))]
        border = border[(ids[border] >= 0) & (ids[border - 1] >= 0)]  # a run ends with its document
        edge = np.sort(np.concatenate([edge, border, border]))
        start, stop = edge[0::2], edge[1::2]
        keep = stop - start >= self.least
        start, stop = start[keep], stop[keep]
        # long runs in pieces; a window that ends in one lies in it, from its ``window - 1`` words in front
        count = np.maximum(-(-(stop - start) // RUN), 1)
        first = np.repeat(start, count) + RUN * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(first + RUN, np.repeat(stop, count))
        start = np.maximum(first - self.window + 1, np.repeat(start, count))
        return self._stream(ids, start, stop, at, cover)

    def _stream(self, ids: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, cover: np.ndarray) -> np.ndarray:
        order = np.argsort(start - stop, kind="stable")  # longest first, so those that go on are in front
        start, size = start[order], (stop - start)[order]
        v, n, found = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), []
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            v, n, w = v[:live], n[:live], ids[start[:live] + t]
            todo = np.arange(live)
            while len(todo):
                key = v[todo] * len(self.vocab) + w[todo]
                place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[place] == key
                v[todo[hit]] = self.to[place[hit]]
                n[todo[hit]] += 1
                todo = todo[~hit & (v[todo] > 0)]  # the others back to shorter matches
                v[todo] = self.link[v[todo]]
                n[todo] = self.len[v[todo]]
            full = np.flatnonzero((n >= self.window) & (self.top[v] >= 0))
            if len(full):
                end = start[full] + t + 1
                np.add.at(cover, end - self.window, 1)
                np.add.at(cover, end, -1)
                found.append(self._held(self.whole, self.top[v[full]], end))
            if len(self.short):
                place, rows = self._rows(self.short, v)
                length, end = rows[:, 1], start[place] + t + 1
                good = n[place] >= length
                np.add.at(cover, (end - length)[good], 1)
                np.add.at(cover, end[good], -1)
                found.append(np.stack([end, rows[:, 2]], axis=1)[good])
        if not found:
            return np.empty((0, 2), np.int64)
        pairs = np.concatenate(found)
        pairs[:, 0] = np.searchsorted(at, pairs[:, 0] - 1, side="right") - 1
        return np.unique(pairs, axis=0)

    @staticmethod
    def _rows(table: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``table`` (sorted by state, in column 0) of each of ``states``, and which one each is of."""
        a, b = np.searchsorted(table[:, 0], states, "left"), np.searchsorted(table[:, 0], states, "right")
        place = np.repeat(np.arange(len(states)), b - a)
        return place, table[np.arange(len(place)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]

    def _held(self, table: np.ndarray, states: np.ndarray, end: np.ndarray) -> np.ndarray:
        place, rows = self._rows(table, states)
        return np.stack([end[place], rows[:, 1]], axis=1)


def shards(benchmark: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> list[str]:
    """Stores an automaton for each shard; their paths."""
    longest = max(shard_words // 4, window)
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("said")).filter("said IS NOT NULL").distinct()
    kind = T.StructType.fromDDL("item string, said binary, n long")

    def cut(batch: pa.RecordBatch):
        for item, text in zip(batch.column("item").to_pylist(), batch.column("said").to_pylist(), strict=True):
            said = words(text)
            parts = [said[i : i + longest] for i in range(0, max(len(said) - window + 1, min(len(said), 1)), longest - window + 1)]
            if parts:
                yield {"item": [item] * len(parts), "said": [b" ".join(p) for p in parts], "n": [len(p) for p in parts]}

    pieces = materialize(map_arrow(rows, cut, kind), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    k, folder = -(-total // shard_words), new_path(benchmark.sparkSession, "automata")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("said", "item"), F.lit(k)))

    def make(group):
        maker = Maker([(i, s.split(b" ")) for i, s in zip(group.column("item").to_pylist(), group.column("said").to_pylist(), strict=True)], window)
        disk, place = fs.FileSystem.from_uri(folder)
        disk.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"  # a failed attempt leaves a file that nobody lists
        with disk.open_output_stream(f"{place}/{name}") as out:
            out.write(maker.stored())
        return pa.table({"name": [name]})

    made = materialize(dealt.groupBy("shard").applyInArrow(make, "name string"), "shards")
    return sorted(f"{folder}/{r['name']}" for r in made.collect())  # a name for each shard



@lru_cache(maxsize=1)
def load(path: str, window: int) -> Automaton:
    """The last one used stays in the worker."""
    kept_by(__name__, load.cache_clear)
    disk, place = fs.FileSystem.from_uri(path)
    with disk.open_input_stream(place) as stream:
        return Automaton(stream.read(), window)


def matches(column: pa.Array, paths: list[str], window: int) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text of a block: the number of words, maximal hit spans (in words, end exclusive) and items."""
    lists = [words(t) for t in column.to_pylist()]
    at = np.cumsum([0, *map(len, lists)])
    said = [w for part in lists for w in part]
    cover, items = np.zeros(len(said) + 1, np.int64), {}
    for path in paths:
        automaton = load(path, window)
        for doc, number in automaton.match(said, at, cover).tolist():
            if automaton.names[number] is not None:
                items.setdefault(doc, set()).add(automaton.names[number])
    hit = np.cumsum(cover[:-1]) > 0
    inside = np.concatenate([[False], hit, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    border = at[1:-1]
    border = np.unique(border[(border > 0) & (border < len(said))])
    border = border[hit[border] & hit[border - 1]]
    edge = np.sort(np.concatenate([edge, border, border])).reshape(-1, 2)
    cuts = np.searchsorted(edge[:, 0], at)
    for i, part in enumerate(lists):
        yield len(part), [(a - int(at[i]), b - int(at[i])) for a, b in edge[cuts[i] : cuts[i + 1]].tolist()], sorted(items.get(i, ()))


def find(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, str]:
    """``df`` with one more column (its name is returned): struct of n_words, spans and items."""
    columns, name = df.columns, free_name(df.columns, "_gf_hits")
    kind = T.StructType.fromDDL("n_words long, spans array<struct<start:int,end:int>>, items array<string>")
    paths = shards(benchmark, item_col, item_text, window, shard_words)

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, text_col, BLOCK_BYTES):
            found = [{"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": items} for n, spans, items in matches(part.column(text_col), paths, window)]
            yield {c: part.column(c) for c in columns} | {name: found}

    return map_arrow(df, run, T.StructType([*df.schema, T.StructField(name, kind)])), name


def report(found: DataFrame, hits: str, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.expr(f"cast(aggregate({hits}.spans, 0, (n, s) -> n + s.end - s.start) as bigint)")
    names = F.expr(f"array_join({hits}.items, ',')")  # sorted as strings already
    items = F.expr(f"cast(size({hits}.items) as bigint)")
    return found.select(F.col(id_col).alias("doc_id"), F.col(f"{hits}.n_words").alias("n_words"), n_hit.alias("n_hit"), items.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, coverage: float = 0.5) -> DataFrame:
    """``df`` without hit spans, and without documents of which more than ``coverage`` is hit."""
    columns, paths = df.columns, shards(benchmark, item_col, item_text, window, shard_words)

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, text_col, BLOCK_BYTES):
            kept, texts = [], {}
            for i, (n, spans, _) in enumerate(matches(part.column(text_col), paths, window)):
                if sum(b - a for a, b in spans) <= coverage * n:
                    kept.append(i)
                    if spans:
                        texts[i] = cut(part.column(text_col)[i].as_py(), spans)
            rows = part.take(pa.array(kept, pa.int64()))
            new = rows.column(text_col).to_pylist() if texts else None
            for k, i in enumerate(kept if texts else ()):
                new[k] = texts.get(i, new[k])
            yield {c: rows.column(c) for c in columns} | ({text_col: new} if texts else {})

    return map_arrow(df, run, df.schema)
