"""Ranked lexical search: branch and bound over trees of document vectors.

Documents are read once: of each, its number of terms and its counts of the terms that any item has are stored
(a restricted term vector).  Vectors are ordered by frequency, the rarest term first, so that paths part early
on what tells documents apart, and those of one task share a trie, with unary paths drawn together.  Each
child of a node has the largest count of every term below it and the least length factor m below it, which
bound the score of any document there.  For each item the trie is searched depth first, children by falling bound, and what can't
reach the item's tenth best score so far is never entered; the best so far stay from trie to trie of a task.
Tables of nodes that no item enters are never made.  A task sends an item's ten best, which are merged in two steps.

Items are worked in blocks of some BLOCK_TERMS terms, against all documents, so what is broadcast is bounded.

Defined cases: null and texts without terms are neither documents nor items; rows with equal ids are documents
(or items) of their own; null ids come first among equal scores; fewer documents with a score above 0 than
asked for are all given; empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from guardframe.llm.common import bound_batches, discard, few, map_arrow, materialize

TOP = 10
BLOCK_TERMS = 500_000  # of items at once
PIECE = 1 << 20  # bytes of a text cut into terms at once
ENTRIES = 500_000  # of a trie
LEAF = 16  # documents that a node parts one by one
DEALS = 64  # parts in which an item's best are merged first
NO_ID = -(2**63)
SMALL = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A term is of digits, Latin letters and everything beyond ASCII, here as UTF-8.
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    raw, start = text.encode().translate(SMALL), 0
    while start < len(raw):
        gap = GAP.search(raw, start + PIECE)
        end = gap.start() if gap else len(raw)
        yield TERM.findall(raw, start, end)
        start = end


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """no, item_id, size and terms (with repeats) of every item that has any."""
    given = items.select(F.monotonically_increasing_id().alias("no"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([given.schema["no"], given.schema["item_id"], *T.StructType.fromDDL("size long, terms array<binary>")])

    def run(batch: pa.RecordBatch):
        terms = [[t for piece in terms_of(x or "") for t in piece] for x in batch.column("text").to_pylist()]
        yield {"no": batch.column("no"), "item_id": batch.column("item_id"), "size": [len(t) for t in terms], "terms": terms}

    return map_arrow(given, run, schema).filter("size > 0")


def vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in ``vocabulary``) and counts of every document with terms."""
    given = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batch: pa.RecordBatch):
        known, n, terms, counts = sent.value.get, [], [], []
        for text in batch.column("text"):
            found, size = Counter(), 0
            for words in terms_of(text.as_py() or ""):
                size += len(words)
                found.update(map(known, words))
            found.pop(None, None)
            n.append(size)
            terms.append(list(found.keys()))
            counts.append(list(found.values()))
        yield {"doc_id": batch.column("doc_id"), "n": n, "terms": terms, "counts": counts}

    return map_arrow(given, run, T.StructType.fromDDL("doc_id long, n long, terms array<int>, counts array<int>")).filter("n > 0")


class Best:
    """The best (score, id) of an item so far."""

    __slots__ = ("rows", "top")

    def __init__(self, top: int):
        self.rows, self.top = [], top

    @property
    def least(self) -> int:
        """What a score must reach; 1 while there is room."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, score: int, doc: int) -> None:
        row = (-score, doc)
        if len(self.rows) < self.top or row < self.rows[-1]:
            insort(self.rows, row)
            del self.rows[self.top :]


class Node:
    """The children of a part of the trie: ranges of documents, and by term the bounds of those that have it."""

    def __init__(self, tree: Trie, lo: int, hi: int, depth: int):
        self.depth = tree.fork(lo, hi, depth)
        firsts = np.arange(lo, hi) if self.depth is None or hi - lo <= LEAF else tree.parts(lo, hi, self.depth)
        self.lo, self.hi = firsts, np.append(firsts[1:], hi)
        a, b = tree.at[lo], tree.at[hi]
        child = np.repeat(np.arange(len(firsts)), tree.at[self.hi] - tree.at[firsts])
        order = np.lexsort((child, tree.term[a:b]))
        term, child, count = tree.term[a:b][order], child[order], tree.count[a:b][order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (child[1:] != child[:-1])
        first = np.flatnonzero(new)
        m = np.minimum.reduceat(tree.m[lo:hi], firsts - lo)
        self.child, most, term = child[first], np.maximum.reduceat(count, first) if len(first) else count, term[first]
        self.value = (10**9 * most) // (1000 * most + 8 * m[self.child])
        self.terms, starts = np.unique(term, return_index=True)
        self.starts = np.append(starts, len(term))
        self.single = self.hi - self.lo == 1

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each child; the score itself where it is a document."""
        out = np.zeros(len(self.lo), np.int64)
        if len(self.terms):
            place = np.searchsorted(self.terms, terms)
            place[place == len(self.terms)] = 0
            hit = np.flatnonzero(self.terms[place] == terms)
            for i, w in zip(place[hit].tolist(), weights[hit].tolist(), strict=True):
                a, b = self.starts[i], self.starts[i + 1]
                out[self.child[a:b]] += w * self.value[a:b]
        return out


class Trie:
    """Documents (ids, m) in order of their vectors: ``term`` (by rank, rarest first) and ``count`` from ``at`` on."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, size: np.ndarray, term: np.ndarray, count: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), size)
        order = np.lexsort((term, doc))
        term, count, at = term[order], count[order], np.concatenate([[0], np.cumsum(size)])
        raw = term.astype(">u4").tobytes()
        path = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        docs = np.array(sorted(range(len(ids)), key=path.__getitem__), np.int64)
        self.path, self.ids, self.m = [path[i] for i in docs.tolist()], ids[docs], m[docs]
        self.at = np.concatenate([[0], np.cumsum(size[docs])])
        take = np.repeat(at[docs] - self.at[:-1], size[docs]) + np.arange(self.at[-1])
        self.term, self.count = term[take], count[take]
        self.nodes: dict[tuple[int, int], Node] = {}

    def fork(self, lo: int, hi: int, depth: int) -> int | None:
        """Where the paths of a range part, not before ``depth``; None if they are one path."""
        a, b = self.path[lo], self.path[hi - 1]
        if a == b:
            return None
        while a[4 * depth : 4 * depth + 4] == b[4 * depth : 4 * depth + 4]:
            depth += 1
        return depth

    def parts(self, lo: int, hi: int, depth: int) -> np.ndarray:
        """The first document of each child: by the term at ``depth``, those whose path ends there first."""
        at = self.at[lo:hi] + depth
        ends = at >= self.at[lo + 1 : hi + 1]
        here = np.where(ends, -1, self.term[np.minimum(at, len(self.term) - 1)])
        return lo + np.concatenate([[0], np.flatnonzero(here[1:] != here[:-1]) + 1])

    def node(self, lo: int, hi: int, depth: int) -> Node:
        if (lo, hi) not in self.nodes:
            self.nodes[lo, hi] = Node(self, lo, hi, depth)
        return self.nodes[lo, hi]

    def entered(self, node: Node, terms: np.ndarray, weights: np.ndarray, best: Best) -> Iterator[tuple[int, int]]:
        """Bound and number of a node's children to enter, by falling bound; documents are added to ``best``."""
        bounds = node.bounds(terms, weights)
        found = np.flatnonzero(bounds >= best.least)
        docs = found[node.single[found]]
        for i in docs[np.lexsort((self.ids[node.lo[docs]], -bounds[docs]))][: best.top].tolist():
            best.add(int(bounds[i]), int(self.ids[node.lo[i]]))
        inner = found[~node.single[found]]
        inner = inner[np.argsort(-bounds[inner], kind="stable")]
        return zip(bounds[inner].tolist(), inner.tolist(), strict=True)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        root = self.node(0, len(self.ids), 0)
        stack = [(root, self.entered(root, terms, weights, best))]
        while stack:
            node, rest = stack[-1]
            bound, i = next(rest, (0, 0))
            if bound < best.least:  # nor do the others reach it
                stack.pop()
                continue
            below = self.node(int(node.lo[i]), int(node.hi[i]), node.depth + 1)
            stack.append((below, self.entered(below, terms, weights, best)))


def found_in(stored: DataFrame, items: dict[int, tuple[np.ndarray, np.ndarray]], rank: np.ndarray, docs: int, length: int, top: int) -> DataFrame:
    """no, doc_id, score: the best of each item among the vectors of each task."""
    sent = stored.sparkSession.sparkContext.broadcast((items, rank))
    bound_batches(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rank = sent.value
        best, held, entries = {no: Best(top) for no in items}, [], 0

        def work() -> None:
            tree = Trie(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for no, (terms, weights) in items.items():
                tree.search(terms, weights, best[no])

        for batch in batches:
            lists, n = batch.column("terms"), batch.column("n").to_pylist()
            m = np.array([25 + 75 * x * docs // length for x in n], np.int64)
            size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            held.append((batch.column("doc_id").to_numpy(), m, size, rank[np.asarray(lists.flatten())], np.asarray(batch.column("counts").flatten()).astype(np.int64)))
            entries += int(size.sum())
            if entries >= ENTRIES:
                work()
                held, entries = [], 0
        if entries:
            work()
        rows = [(no, doc, -score) for no, b in best.items() for score, doc in b.rows]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 10_000], strict=True)], names=["no", "doc_id", "score"])

    return stored.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(run, "no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item that score above 0.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), N the documents with terms; a document adds
    1000000000 tf div (1000 tf + 8 m) times that for each of the item's terms, repeats included, where
    m = 25 + 75 n N div L, n the document's terms and L those of all.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_id, item_text), "items")
    total = asked.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b).select("no", "terms").collect()  # a block
        given = {r["no"]: Counter(map(bytes, r["terms"])) for r in rows}
        vocabulary = sorted({t for c in given.values() for t in c})
        stored = materialize(vectors(docs, vocabulary, id_col, text_col), "vectors")
        sizes = stored.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        held = {r["term"]: r["df"] for r in stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        df = np.array([held.get(i, 0) for i in range(len(vocabulary))], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
        number = {t: i for i, t in enumerate(vocabulary)}
        weigh = lambda f: math.floor(1000 * math.log((2 * sizes["docs"] + 2) / (2 * f + 1)))
        ready = {}
        for no, counts in given.items():
            pairs = sorted((int(rank[i]), k * weigh(int(df[i]))) for i, k in ((number[t], k) for t, k in counts.items()) if df[i])
            if pairs := [p for p in pairs if p[1]]:
                ready[no] = tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True))
        parts.append(materialize(found_in(stored, ready, rank, sizes["docs"], sizes["length"] or 1, top), "best"))
        discard(stored)
    if not parts:
        return spark.createDataFrame([], T.StructType([asked.schema["item_id"], *T.StructType.fromDDL("rank int, doc_id long, score long")]))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    some = found.withColumn("_gf_deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("no", "_gf_deal").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= top)
    named = ranked.join(few(asked.select("no", "item_id")), "no")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
