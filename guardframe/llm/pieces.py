"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut where no piece of the vocabulary can cross, the distinct parts are joined and
indexed by a suffix array as deep as the longest piece.  Every piece is looked up by binary search,
which gives the range of its occurrences.  The occurrences are edges of a lattice; sorted by their end
they are relaxed from left to right:

* for a unigram model an edge is relaxed by its score, as in the shortest path;
* for a BPE model an edge is taken where merging would leave it and the edge before it side by side
  (``Model.adjacent``).  Of the edges that end at a place just one is, so the path is the one that
  merging in order of rank gives, and ids equal those of the sentencepiece library.

Characters that no piece covers become byte pieces, or the unknown id if the model has none.

Defined cases: null and empty texts have no ids; any Unicode text is decoded to what it was, but that the
space mark itself (U+2581) comes back as a space (models with byte pieces); a model that normalises texts
in another way than by its space mark is refused; repeated rows and null ids are rows like others; an
empty table gives no rows; other columns are ignored unless asked for.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from guardframe.llm.common import blocks, free_name, kept_by, map_arrow

SPACE = "▁"
MEMO_BYTES = 80 << 20
PART_BYTES = 220  # of a part, its ids and their place in the table
INDEXED = 120_000  # characters indexed at once
BATCH = 1 << 20
BORDER = "\x1f"
MARKS = ".,;:!?|*%&$#"
NEVER = 1 << 40


class Model:
    """Pieces of a model file, their order of merging, and a cache of which pairs stay apart."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.score = np.array([lib.get_score(i) for i in range(n)])
        self.plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.ids = {self.text[i]: i for i in self.plain}
        self.depth = -(-max(len(self.text[i]) for i in self.plain) // 4) * 4  # of the suffix array, in whole words
        alphabet = sorted({c for i in self.plain for c in self.text[i]})
        if not all(c in self.ids for c in alphabet):
            raise ValueError("a character of a piece is no piece by itself")
        self.symbol = np.full(0x110000, 1, np.uint16)  # 0 parts texts, 1 is any character that no piece has
        for k, c in enumerate(alphabet):
            self.symbol[ord(c)] = k + 2
        long = [self.text[i] for i in self.plain if len(self.text[i]) > 1]
        self.spaces_lead = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long)
        self.lines_alone = not any("\n" in p for p in long)
        crossed = {b for p in long for a, b in zip(p, p[1:], strict=False) if a != SPACE and a not in MARKS}
        marks = "".join(m for m in MARKS if m not in crossed)
        self.cut = cutter(marks, self.lines_alone)
        self.simple = self.spaces_lead and self.lines_alone and not marks
        self.merges = trained_as(lib) == "bpe"
        if self.merges:
            self._order()
        low = self._keys([self.text[i] for i in self.plain])
        high = np.ascontiguousarray(np.where(low == 0, 0xFFFF, low).astype(">u2"))
        self.low, self.high = (x.view(f"S{2 * self.depth}").ravel() for x in (low, high))  # the range of what begins with a piece
        self.sizes = np.array([len(self.text[i]) for i in self.plain])
        self.cache_key, self.cache = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _order(self) -> None:
        """Rank of each piece, what each consists of when merged, and the pairs that merge."""
        self.rank = np.full(len(self.text), NEVER, np.int64)
        for i in self.plain:
            if len(self.text[i]) > 1:
                self.rank[i] = int(-self.score[i])
        left, right, pairs = np.full(len(self.text), -1, np.int64), np.full(len(self.text), -1, np.int64), {}
        for i in self.plain:
            p = self.text[i]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
            if len(p) > 1:
                left[i], right[i] = self._halves(p)
        self.left, self.right = left, right
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], self.rank[np.array(list(pairs.values()))][order]

    def _halves(self, piece: str) -> tuple[int, int]:
        """The two pieces whose merge makes ``piece``; (-1, -1) where merging never makes it."""
        parts = list(piece)
        while len(parts) > 2:
            ranked = [(self.rank[i], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (i := self.ids.get(a + b)) is not None and len(a + b) < len(piece)]
            if not ranked:
                return -1, -1
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        a, b = (self.ids.get(p, -1) for p in parts)
        return (a, b) if a >= 0 and b >= 0 else (-1, -1)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b side by side.

        Undo merges next to the border, latest first: at no time may a merge across the border have
        come before the merge that took its left or right part away.
        """
        a, b = a.copy(), b.copy()
        apart = np.ones(len(a), bool)
        until = np.full(len(a), NEVER, np.int64)  # a merge across must have a smaller time than this to be wrong
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            # times: twice the rank; of equal ranks the left one goes first
            wrong = 2 * self.merge_rank(x, y) < until[todo]
            apart[todo[wrong]] = False
            rx = np.where(self.left[x] >= 0, self.rank[x], -1)
            ry = np.where(self.left[y] >= 0, self.rank[y], -1)
            go = ~wrong & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry = todo[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            # undoing the left piece: a merge across of the same rank is further right, so later
            a[todo[undo_left]] = self.right[x[undo_left]]
            until[todo[undo_left]] = 2 * rx[undo_left]
            # undoing the right piece: a merge across of the same rank is further left, so earlier
            b[todo[~undo_left]] = self.left[y[~undo_left]]
            until[todo[~undo_left]] = 2 * ry[~undo_left] + 1
        return apart

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart`` with a cache; characters without a piece (-2) keep all others apart."""
        out = (a == -2) | (b == -2)
        todo = np.flatnonzero(~out)
        key = (a[todo] << 20) | b[todo]
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        known = self.cache_key[slot] == key
        out[todo[known]] = self.cache[slot[known]]  # before new pairs take slots
        miss = np.flatnonzero(~known)
        if len(miss):
            new, first = np.unique(key[miss], return_index=True)
            at = slot[miss][first]
            self.cache_key[at] = new
            made = self._apart(new >> 20, new & 0xFFFFF)
            self.cache[at] = made
            out[todo[miss]] = made[np.searchsorted(new, key[miss])]
        return out

    def _keys(self, texts: list[str]) -> np.ndarray:
        """Symbols of each text as big-endian bytes, which compare as the texts do."""
        out = np.zeros((len(texts), self.depth), ">u2")
        for k, t in enumerate(texts):
            out[k, : len(t)] = self.symbol[[ord(c) for c in t]]
        return out

    def parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The normalised texts, cut where no piece can cross, and the place of each one's first part (and the end).

        Texts with single spaces only are cut by Arrow, at spaces and line ends; others by a pattern.
        """
        column = pa.array(texts, pa.large_string())
        if self.simple and not np.asarray(pc.match_substring_regex(column, f"  |^ |{BORDER}|{SPACE}")).any():
            marked = pc.replace_substring(pc.replace_substring(column, " ", BORDER + SPACE), "\n", f"{BORDER}\n{BORDER}")
            cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), marked, pa.scalar("", pa.large_string())), BORDER)
            lists = pc.if_else(pc.equal(column, ""), pa.scalar([], cut.type), cut) if "" in texts else cut
            return lists.flatten(), np.asarray(lists.offsets, np.int64)
        lists = []
        for text in texts:
            text = SPACE + text.replace(" ", SPACE) if text else ""
            lists.append((self.cut.findall(text) if self.spaces_lead else [text]) if text else [])
        return pa.array(list(chain.from_iterable(lists)), pa.large_string()), np.cumsum([0, *map(len, lists)])


def trained_as(library) -> str:
    """``bpe`` or ``unigram``, as the model file says; anything but identity normalisation is refused.

    Reads the two parts of the file's message that tell it: trainer_spec (2) and normalizer_spec (3).
    """
    spec = {n: v for n, v in fields(library.serialized_model_proto()) if n in (2, 3)}
    kind = {1: "unigram", 2: "bpe"}.get(next((v for n, v in fields(spec.get(2, b"")) if n == 3), 1))
    rules = dict(fields(spec.get(3, b"")))
    changed = rules.get(2) or rules.get(1, b"identity") not in (b"identity", b"")  # a map of characters; its name
    if changed or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):  # a space in front, extra spaces, the space mark
        raise ValueError("the model normalises texts in another way than by its space mark")
    if kind is None:
        raise ValueError("the model is neither of the BPE nor of the unigram kind")
    return kind


def fields(message: bytes):
    """(number, value) of the fields of a serialized message: numbers and bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


def cutter(marks: str, lines: bool) -> re.Pattern:
    """Parts: space marks with what follows, up to the next space mark, up to a line end if no piece has
    one, and up to one of ``marks``, which no piece joins to a character before."""
    stop = SPACE + "\n" * lines
    plain = f"[^{stop}{re.escape(marks)}]+"
    marked = f"[{re.escape(marks)}][^{stop}]*" if marks else "(?!)"
    return re.compile(f"{SPACE}+(?:{plain}|{marked})?|{plain}|{marked}" + "|\n" * lines)


def sort_windows(windows: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian symbols: sorted by four symbols, ties by the next four."""
    words = windows.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0])
    for k in range(1, words.shape[1]):
        before = words[order, k - 1]
        rank = np.zeros(len(order), np.int64) if k == 1 else rank
        new = np.zeros(len(order), bool)
        new[1:] = before[1:] != before[:-1]
        rank = np.cumsum(new | np.concatenate([[False], np.diff(rank) > 0]))  # ties so far share a rank
        tied = np.bincount(rank)[rank] > 1
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        part = order[rows]
        by = np.lexsort((words[part, k], rank[rows]))
        order[rows] = part[by]
    return order


def lattice(model: Model, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, end, piece or -2) over the joined parts, and each part's start.

    A separator stands after each part, so no edge crosses from one into the next.
    """
    joined = "\0".join(parts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    symbols = model.symbol[codes]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = symbols.copy()
    symbols[begin[1:] - 1] = 0
    depth = model.depth
    padded = np.concatenate([symbols, np.zeros(depth, np.uint16)]).astype(">u2")
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(symbols)])
    keys = windows.view(f"S{2 * depth}").ravel()
    suffixes = sort_windows(windows)  # the suffix array, as deep as the longest piece
    ordered = keys[suffixes]
    first = np.searchsorted(ordered, model.low, "left")
    last = np.searchsorted(ordered, model.high, "right")
    count = last - first
    hit = np.flatnonzero(count)
    piece = np.repeat(np.asarray(model.plain)[hit], count[hit])
    place = np.arange(len(piece)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit]) + np.repeat(first[hit], count[hit])
    start = suffixes[place]
    end = start + np.repeat(model.sizes[hit], count[hit])
    covered = np.zeros(len(symbols), bool)
    covered[start[end == start + 1]] = True
    bare = np.flatnonzero(~covered & (symbols != 0))  # characters that are no piece by themselves
    start, end = np.concatenate([start, bare]), np.concatenate([end, bare + 1])
    piece = np.concatenate([piece, np.full(len(bare), -2, np.int64)])
    return start, end, piece, begin


def relax(model: Model, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all parts, and the place of each one's first (and the end).

    A character without a piece gives -2 less its place in the joined parts.
    """
    start, end, piece, begin = lattice(model, parts)
    total = int(begin[-1])
    origin = np.zeros(total + 1, np.int64)  # start of the part that a place belongs to
    origin[begin[:-1]] = begin[:-1]
    np.maximum.accumulate(origin, out=origin)
    came, taken = np.full(total + 1, -1, np.int64), np.full(total + 1, -1, np.int64)
    best = np.full(total + 1, -np.inf)
    best[begin[:-1]] = 0
    level = end - origin[start]
    # by end within the part; narrow numbers are sorted in linear time
    order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
    start, end, piece, level = start[order], end[order], piece[order], level[order]
    steps = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]])
    at_begin = np.zeros(total + 1, bool)
    at_begin[begin[:-1]] = True
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        s, e, p = start[a:b], end[a:b], piece[a:b]
        if model.merges:
            free = at_begin[s]
            ok = free.copy()
            later = np.flatnonzero(~free & (taken[s] != -1))
            ok[later] = model.adjacent(taken[s[later]], p[later])
            # a piece that merging never makes can't be an edge of the path
            ok &= (p == -2) | (model.left[p] >= 0) | (model.rank[p] == NEVER)
            taken[e[ok]], came[e[ok]] = p[ok], s[ok]
        else:
            worth = best[s] + np.where(p >= 0, model.score[np.maximum(p, 0)], model.score.min() - 10)
            by = np.lexsort((worth, e))
            top = np.concatenate([np.flatnonzero(np.diff(e[by])), [len(by) - 1]]) if len(by) else by
            s, e, p, worth = s[by[top]], e[by[top]], p[by[top]], worth[by[top]]
            taken[e], came[e], best[e] = p, s, worth
    # all parts walk back together, a step at a time
    now, ends = begin[1:] - 1, begin[:-1]
    walked, who = [], []
    live = np.flatnonzero(now > ends)
    while len(live):
        here = now[live]
        walked.append(np.stack([taken[here], came[here]]))
        who.append(live)
        now[live] = came[here]
        live = live[now[live] > ends[live]]
    if not walked:
        return np.empty(0, np.int64), np.zeros(len(parts) + 1, np.int64)
    ids, places, who = np.concatenate([w[0] for w in walked]), np.concatenate([w[1] for w in walked]), np.concatenate(who)
    order = np.argsort(places)
    ids, places, who = ids[order], places[order], who[order]
    out = np.where(ids == -2, -2 - places, ids)  # where a bare character stands
    return out, np.searchsorted(who, np.arange(len(parts) + 1))


class Codec:
    """Texts to ids and back, with a memo of two generations that go by turns."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        self.model, self.limit, self.memo, self.old = Model(path), memo_bytes // 2, {}, {}

    def learn(self, parts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of parts, indexed some at a time."""
        if not parts:
            return []
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // INDEXED, prepend=-1)).tolist()
        return [x for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True) for x in self._learn(parts[a:b], sizes[a:b])]

    def _learn(self, parts: list[str], sizes: np.ndarray) -> list[bytes]:
        model = self.model
        ids, cuts = relax(model, parts)
        raw, at = ids.astype("<i4").tobytes(), (4 * cuts).tolist()
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        begin = np.cumsum(sizes) - sizes
        for i in np.unique(np.searchsorted(cuts, np.flatnonzero(ids < 0), side="right") - 1).tolist():
            made: list[int] = []
            for k in ids[cuts[i] : cuts[i + 1]].tolist():
                if k >= 0:
                    made.append(k)
                elif model.bytes:
                    made += [model.bytes[b] for b in parts[i][-2 - k - int(begin[i])].encode("utf-8")]
                else:
                    made.append(model.unknown)
            out[i] = struct.pack(f"<{len(made)}i", *made)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the place of each one's first (and the end)."""
        flat, at = self.model.parts([t or "" for t in texts])
        coded = flat.dictionary_encode()
        known, order = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        memo, old = self.memo, self.old
        table, new = list(map(memo.get, known)), []
        for i, held in enumerate(table):
            if held is None:
                ids = old.get(known[i])
                if ids is None:
                    new.append(i)
                else:
                    table[i] = memo[known[i]] = ids
        for i, ids in zip(new, self.learn([known[i] for i in new]), strict=True):
            table[i] = memo[known[i]] = ids
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        first, count = np.cumsum(size) - size, size[order]
        stop = np.cumsum(count)
        ids = np.frombuffer(b"".join(table), "<i4")[np.repeat(first[order] - stop + count, count) + np.arange(count.sum())]
        if len(memo) * PART_BYTES > self.limit:
            self.memo, self.old = {}, memo
        return ids, np.concatenate([[0], stop])[at]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as UTF-8, the leading space mark dropped."""
        model, out, held = self.model, [], bytearray()
        value = {i: b for b, i in model.bytes.items()}
        for i in ids:
            if i in value:
                held.append(value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(model.text[i].replace(SPACE, " ") if i != model.unknown else " ⁇ ")
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """``decode`` of many id lists at once through tables of bytes."""
        model = self.model
        if not hasattr(self, "table"):
            value = {i: bytes([b]) for b, i in model.bytes.items()}
            each = [value.get(i, t.replace(SPACE, " ").encode()) for i, t in enumerate(model.text)]
            each[model.unknown] = " ⁇ ".encode()
            self.table = each
        get, whole = self.table.__getitem__, ids.tolist()
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            text = b"".join(map(get, whole[a:b])).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each worker process: the tables and the memo serve all tasks of this operator that run there."""
    kept_by(__name__, codec.cache_clear)
    return Codec(path)


def encode(df: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Columns ``keep`` and one of id lists, whose name is returned."""
    keep = ["doc_id"] if keep is None else keep
    name = free_name(keep, "ids")
    work = df.select(*keep, F.col(text_col).alias("_gf_text"))
    schema = T.StructType([*(f for f in work.schema if f.name != "_gf_text"), T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, "_gf_text", BATCH):
            ids, at = codec(model).encode(part.column("_gf_text").to_pylist())
            yield {c: part.column(c) for c in keep} | {name: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))}

    return map_arrow(work, run, schema), name


def summary(encoded: DataFrame, name: str, model: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and, of the text decoded from the ids, its length and CRC-32."""
    schema = T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "ids_crc32", "text_chars", "text_crc32"))])

    def run(batch: pa.RecordBatch):
        lists = batch.column(name)
        ids, at = np.asarray(lists.values), np.asarray(lists.offsets)
        texts = codec(model).decode_all(ids, at)
        yield {
            "doc_id": batch.column(id_col), "n_tokens": np.diff(at), "text_chars": [len(t) for t in texts],
            "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:], strict=True)], "text_crc32": [zlib.crc32(t.encode()) for t in texts],
        }

    return map_arrow(encoded, run, schema)
