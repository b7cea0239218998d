"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` computes counts over every whole text, ``train`` fits trees with squared-gradient
histograms on a bounded sample of labelled rows (``SAMPLE``), and ``Forest`` holds them as flat numpy
arrays for vectorised scoring.  Shares of symbols, of repeated lines and of repeated words are
monotone: more of them never raises a score.

Defined cases: a null text has no words, so the base rule rejects it; labels without a document, null
labels and repeated labels are left out of the sample or count as they are; with no labelled row of
either class the verdict is the base rule's; repeated or null ids and other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from guardframe.llm.common import blocks, map_arrow
from guardframe.llm.words import Block, per_doc, same_ranges

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SAMPLE = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?.,;:")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
#: Feature name and its direction: -1 where more must not raise the score.
FEATURES = [("log_words", 0), ("word_chars", 0), ("symbols", -1), ("dup_lines", -1), ("repeat_words", -1), ("upper", 0), ("digits", 0), ("marks", 0), ("distinct", 0), ("line_words", 0)]


def leaders(*keys: np.ndarray) -> np.ndarray:
    """The place of the first element with the same keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def by_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
    """``lead`` as it is where the bytes are equal; else by a dictionary."""
    size, far = end - start, np.flatnonzero(lead != np.arange(len(lead)))
    if (size[far] == size[lead[far]]).all() and same_ranges(raw, start[far], start[lead[far]], size[far]).all():
        return lead
    first: dict = {}
    data, own = raw.tobytes(), np.zeros(len(lead), int) if doc is None else doc
    return np.array([first.setdefault((own[i], data[start[i] : end[i]]), i) for i in range(len(lead))], np.int64)


def count_block(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of the documents of one block."""
    b = Block(column)
    raw, at, n = b.raw, b.at, b.n
    inside = b.inside & ((raw & 0xC0) != 0x80)  # first bytes of the characters in words
    out = {"n_words": b.count, "word_chars": per_doc(inside, at), "n_symbols": per_doc(SYMBOLS[raw], at), "n_upper": per_doc(UPPER[raw], at), "n_digits": per_doc(DIGIT[raw], at), "n_marks": per_doc(MARKS[raw], at)}
    words = by_bytes(raw, b.start, b.end, leaders(b.word_hashes()))  # equal words have equal numbers
    start, key = b.windows(WINDOW, words.astype(np.uint64))
    lead = leaders(b.doc[start], key)
    if not all((words[start + j] == words[start[lead] + j]).all() for j in range(WINDOW)):
        first: dict = {}
        lead = np.array([first.setdefault((b.doc[i], *words[i : i + WINDOW].tolist()), k) for k, i in enumerate(start)], np.int64)
    hit = start[np.bincount(lead, minlength=len(lead))[lead] > 1]
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(cover[:-1]) > 0, b.first)
    out["n_distinct"] = per_doc(leaders(b.doc, words) == np.arange(len(words)), b.first)
    # lines: from a document's start or after \n, up to the next \n or the document's end
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([at[:-1], ends + 1])
    stops = np.concatenate([ends, at[1:]])
    starts, stops = np.sort(starts), np.sort(stops)
    keep = stops > starts
    starts, stops = starts[keep], stops[keep]
    filled = np.searchsorted(b.start, stops) > np.searchsorted(b.start, starts)
    starts, stops = starts[filled], stops[filled]
    doc = np.searchsorted(at, starts, side="right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    lead = by_bytes(raw, starts, stops, leaders(doc, b.bytes(starts, stops)), doc)
    out["n_dup_lines"] = np.bincount(doc[lead != np.arange(len(doc))], minlength=n)
    return out


def statistics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of each row and COUNTS of its text."""
    keep = ["doc_id"] if keep is None else keep
    work = df.select(*keep, F.col(text_col).alias("_gf_text"))
    schema = T.StructType([*(f for f in work.schema if f.name != "_gf_text"), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, "_gf_text", 1 << 20):
            yield {c: part.column(c) for c in keep} | count_block(part.column("_gf_text"))

    return map_arrow(work, run, schema)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, c["n_distinct"] / words, words / lines], axis=1)


@dataclass
class Forest:
    """Trees as flat arrays: node i tests feature[i] <= cut[i] and goes to left[i] or left[i] + 1.

    Leaves point at themselves by ``left[i] = i`` with an infinite cut; ``value`` holds their scores.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Boosted trees for the logistic loss over binned features, monotone where asked."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)  # bin <= i: x <= cuts[i]
    p = y.mean()
    start = float(np.log(p / (1 - p)))
    score = np.full(len(y), start)
    feature, cut, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        cut.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    def grow(at: int, rows: np.ndarray, low: float, high: float, level: int) -> None:
        g, h = grad[rows], hess[rows]
        leaf = lambda a, b: min(max(a / (b + ridge), low), high)
        gain = lambda a, b, v: a * v - 0.5 * (b + ridge) * v * v
        here = leaf(g.sum(), h.sum())
        value[at] = rate * here
        best = (gain(g.sum(), h.sum(), here) + 1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                for i in np.flatnonzero((ns >= least) & (ns <= len(rows) - least)):
                    l, r = leaf(gs[i], hs[i]), leaf(g.sum() - gs[i], h.sum() - hs[i])  # noqa: E741
                    if directions[f] * (r - l) < 0:
                        continue
                    won = gain(gs[i], hs[i], l) + gain(g.sum() - gs[i], h.sum() - hs[i], r)
                    if won > best[0]:
                        best = (won, (f, i, l, r))
        if best[1] is None:
            score[rows] += value[at]
            return
        f, i, l, r = best[1]  # noqa: E741
        feature[at], cut[at], left[at] = f, float(cuts[f][i]), node()
        other = node()
        goes = binned[rows, f] > i
        middle = (l + r) / 2
        down = directions[f]
        grow(left[at], rows[~goes], low if down >= 0 else max(low, middle), high if down <= 0 else min(high, middle), level + 1)
        grow(other, rows[goes], low if down <= 0 else max(low, middle), high if down >= 0 else min(high, middle), level + 1)

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, prob * (1 - prob)
        roots.append(node())
        grow(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots), depth, start)


def base_failed() -> Column:
    """The base rule over COUNTS."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def sample_of(df: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", limit: int = SAMPLE, where: Column | None = None) -> DataFrame:
    """Text and label of at most ``limit`` labelled rows, the smallest by a hash of their id.

    Of the rows of one id one is taken, so the bound holds however often ids are repeated, and at every size of
    the corpus; the model alone is fitted on it.
    """
    chosen = labels.select(F.col(id_col).alias("_gf_id"), F.col(target).cast("int").alias("_gf_y")).filter("_gf_id IS NOT NULL AND _gf_y IS NOT NULL")
    if where is not None:
        chosen = chosen.filter(where)
    chosen = chosen.orderBy(F.xxhash64("_gf_id"), "_gf_id", "_gf_y").limit(limit)
    rows = df.select(F.col(id_col).alias("_gf_id"), F.col("text").alias("_gf_text")).join(F.broadcast(chosen.distinct()), "_gf_id")
    # each task lets go of all but one row of an id before they are dealt out
    first = F.row_number().over(Window.partitionBy("_gf_id", "_gf_y").orderBy(F.xxhash64("_gf_text"), "_gf_text"))
    return rows.withColumn("_gf_first", first).filter("_gf_first = 1").select("_gf_text", "_gf_y")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", limit: int = SAMPLE) -> Forest | None:
    """Trees for ``labels.quality``, or None without labelled rows of both classes."""
    sample = statistics(sample_of(df, labels, "quality", id_col, limit), "_gf_text", ["_gf_y"]).toPandas()
    y = sample["_gf_y"].to_numpy(float)
    if len(y) < 2 or y.min() == y.max():
        return None
    order = np.lexsort([sample[c].to_numpy() for c in [*COUNTS, "_gf_y"]])  # the same trees whatever order rows come in
    return train(features({c: sample[c].to_numpy()[order] for c in COUNTS}), y[order], [d for _, d in FEATURES])


def judge(df: DataFrame, forest: Forest | None, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """id, COUNTS, base_failed, score and kept of every row."""
    work = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_gf_text"))
    schema = T.StructType([work.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, "_gf_text", 1 << 20):
            counts = count_block(part.column("_gf_text"))
            score = np.ones(part.num_rows) if forest is None else forest.score(features(counts))
            yield {"doc_id": part.column("doc_id")} | counts | {"score": score}

    out = map_arrow(work, run, schema).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
