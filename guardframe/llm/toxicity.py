"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding.

Texts are folded first: small letters, compatibility forms and look-alike letters of other scripts
to Latin ones, digits and signs inside words to the letters they stand for.  The lexicon consists of
word beginnings and whole words.  It is learned, with its weights, from a bounded sample of labelled
rows (``SAMPLE``): log odds of a document being toxic; every feature whose counts chance doesn't explain, even as
the oddest of all features (likelihood ratio above FACTOR times the log of their number), is an entry, unless it is a form of another one that says as much.  Words that begin like a lexicon entry, and pairs of
words with one of them, that are as common in clean documents are exception phrases: an entry inside one
doesn't count.  The summed
weights are normalised by the number of words and calibrated to a probability.

Defined cases: null and empty texts score as a text without any match; without labelled rows of both
classes all scores are 0; repeated or null ids are rows like others; other columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from guardframe.llm.common import blocks, free_name, map_arrow
from guardframe.llm.quality import sample_of

SAMPLE = 12_000
LEAST, MOST = 3, 8  # letters of a word's beginning
FACTOR = 1.5  # of the log of the number of features, which an entry's likelihood ratio exceeds
EXCEPTION = 5
BLOCK_BYTES = 4 << 20
CUTOFF = 0.3
#: Letters of other scripts that look like Latin ones, and what digits and signs stand for.
ALIKE = str.maketrans("аеорсхуіјѕԁһӏνοαρτυкмтвнɑɡⅼ", "aeopcxyijsdhlvoaptukmtbhagl")
DIGITS = str.maketrans("0134578", "oieastb")
SIGNS = str.maketrans("@$!|", "asil")
SIGNED = re.compile(r"(?<=[^\W\d_])[@$!|]+(?=[^\W\d_])|(?<![^\s])[@$]+(?=[^\W\d_])")
DIGITED = re.compile(r"[0-9]*[^\W\d_][^\W_]*")
HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
WORD = re.compile(r"[^\W_]+")
OTHER_SCRIPT = re.compile("[\u0370-\u052f\u0251\u0261\u217c\uff01-\uff5e\u00ad\u200b-\u200f\u2060\ufeff\U0001d400-\U0001d7ff]")


def fold(text: str) -> str:
    """The text as it is matched: folded words, a space before and after each."""
    text = text.lower()
    if not text.isascii() and OTHER_SCRIPT.search(text):
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text)).lower().translate(ALIKE)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = SIGNED.sub(lambda m: m[0].translate(SIGNS), text)
    if any(d in text for d in "0134578"):
        text = DIGITED.sub(lambda m: m[0].translate(DIGITS), text)
    return f" {' '.join(WORD.findall(text))} "


def beginnings(word: str):
    """Lexicon entries that a word can match: ' ' + beginning, and ' ' + word + ' '."""
    for n in range(LEAST, min(MOST, len(word)) + 1):
        yield " " + word[:n]
    yield f" {word} "


@dataclass
class Lexicon:
    """Entries with weights, exception words, and the calibration of sums to probabilities."""

    weights: dict
    exceptions: frozenset
    bias: float = -20.0
    by_share: float = 0.0
    by_sum: float = 0.0
    machine = None

    def build(self) -> Lexicon:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for x, w in self.weights.items():
            self.machine.add_word(x, (len(x), w))
        for x in self.exceptions:
            self.machine.add_word(x, (len(x), None))
        if len(self.machine):
            self.machine.make_automaton()
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def sums(self, folded: str) -> float:
        """The weights of matches; of those that begin at one place the heaviest, none within an exception."""
        if self.machine is None:
            self.build()
        if not len(self.machine):
            return 0.0
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, w) in self.machine.iter(folded):
            if w is None:
                free.append((end - n + 1, end))
            else:
                best[end - n + 1] = max(best.get(end - n + 1, 0.0), w)
        return sum(w for at, w in best.items() if not any(a <= at < b for a, b in free))

    def score(self, text: str | None) -> float:
        folded = fold(text) if text else "  "
        return float(self.probability(np.array([self.sums(folded)]), np.array([folded.count(" ") - 1]))[0])

    def probability(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        share, size = inputs(sums, words).T
        return 1 / (1 + np.exp(-np.clip(self.bias + self.by_share * share + self.by_sum * size, -30, 30)))


def inputs(sums: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What is calibrated: matched weight for each word, and in all."""
    return np.stack([np.log1p(100 * sums / np.maximum(words, 1)), np.log1p(sums)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the bias comes first."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of a row must not be learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_counts(sample: DataFrame) -> DataFrame:
    """feature, toxic and clean documents that hold it; features of each text are made once."""
    schema = T.StructType.fromDDL("feature string, toxic long, clean long")

    def run(batch: pa.RecordBatch):
        counts: list[Counter] = [Counter(), Counter()]
        for text, y in zip(batch.column("_gf_text").to_pylist(), batch.column("_gf_y").to_pylist(), strict=True):
            counts[y != 0].update({f for w in set(fold(text or "").split()) for f in beginnings(w)})
        keys = list(counts[0].keys() | counts[1].keys())
        yield {"feature": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]}

    return map_arrow(sample, run, schema).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", limit: int = SAMPLE) -> Lexicon:
    """A lexicon from at most ``limit`` labelled rows that aren't held out."""
    sample = sample_of(df, labels, "toxic", id_col, limit, ~held_out("_gf_id")).persist()
    sizes = {r["_gf_y"] != 0: r["n"] for r in sample.groupBy("_gf_y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        sample.unpersist()
        return Lexicon({}, frozenset())
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    t, c, share = F.col("toxic"), F.col("clean"), bad / (bad + good)
    surprise = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    counted = document_counts(sample.dropDuplicates(["_gf_text", "_gf_y"])).withColumns({"odds": odds, "surprise": surprise}).persist()
    sure = counted.filter((F.col("odds") > 1.0) & (F.col("surprise") > FACTOR * float(np.log(max(counted.count(), 1)))))
    ranked = sure.orderBy((F.col("toxic") * F.col("odds")).desc(), F.length("feature").desc(), "feature").toLocalIterator()
    weights: dict[str, float] = {}
    longer: dict[str, float] = {}  # of every beginning of an entry the heaviest entry
    for r in ranked:  # a shorter or longer form of an entry adds nothing where it holds about the same documents
        f, w = r["feature"], float(r["odds"])
        kin = [weights[f[:n]] for n in range(LEAST + 1, len(f)) if f[:n] in weights]
        if all(w > k + 0.5 for k in kin) and longer.get(f, -1.0) < w:
            weights[f] = w
            for n in range(LEAST + 1, len(f)):
                longer[f[:n]] = max(w, longer.get(f[:n], w))
    counted.unpersist()
    lexicon = Lexicon(weights, find_exceptions(sample, weights, bad, good))
    x, y = measured(sample, lexicon)
    sample.unpersist()
    lexicon.bias, lexicon.by_share, lexicon.by_sum = map(float, logistic(x, y))
    return lexicon


def phrases(folded: str, weights: dict) -> set[str]:
    """Words that an entry matches the beginning of, each alone and with the word before and after it."""
    words, out = folded.split(), set()
    for i, w in enumerate(words):
        held = f" {w} "
        if held in weights:
            single = False  # an entry itself is no exception, phrases with it may be
        elif any(held[:n] in weights for n in range(LEAST + 1, len(held))):
            single = True
        else:
            continue
        out |= {held} if single else set()
        out |= {f" {words[i - 1]} {w} "} if i else set()
        out |= {f" {w} {words[i + 1]} "} if i + 1 < len(words) else set()
    return out


def find_exceptions(sample: DataFrame, weights: dict, bad: int, good: int) -> frozenset:
    """Phrases of at least ``EXCEPTION`` clean documents that tell of a clean one; the sample bounds them."""
    schema = T.StructType.fromDDL("phrase string, toxic long, clean long")

    def run(batch: pa.RecordBatch):
        counts: list[Counter] = [Counter(), Counter()]
        for text, y in zip(batch.column("_gf_text"), batch.column("_gf_y").to_pylist(), strict=True):
            counts[y != 0].update(phrases(fold(text.as_py() or ""), weights))
        keys = list(counts[0].keys() | counts[1].keys())
        yield {"phrase": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]}

    if not weights:
        return frozenset()
    counted = map_arrow(sample, run, schema).groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    found = {r["phrase"] for r in counted.filter((F.col("clean") >= EXCEPTION) & (odds < 0)).collect()}
    return frozenset(p for p in found if p.count(" ") == 2 or not {f" {w} " for w in p.split()} & found)


def measured(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """What is calibrated and the label, of each row of the sample; only these numbers leave the tasks."""

    def run(batch: pa.RecordBatch):
        sums, words = [], []
        for text in batch.column("_gf_text"):
            folded = fold(text.as_py() or "")
            sums.append(lexicon.sums(folded))
            words.append(folded.count(" ") - 1)
        x = inputs(np.array(sums), np.array(words))
        yield {"share": x[:, 0], "size": x[:, 1], "y": [float(y != 0) for y in batch.column("_gf_y").to_pylist()]}

    rows = map_arrow(sample, run, T.StructType.fromDDL("share double, size double, y double")).toPandas()
    rows = rows.sort_values(["y", "share", "size"])  # the same sums whatever order rows come in
    return rows[["share", "size"]].to_numpy(), rows["y"].to_numpy()


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with one more column of scores, whose name is returned."""
    columns = df.columns
    name = free_name(columns, "_gf_toxicity")
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, text_col, BLOCK_BYTES):
            sums, words = [], []
            for text in part.column(text_col):
                folded = fold(text.as_py() or "")
                sums.append(sent.value.sums(folded))
                words.append(folded.count(" ") - 1)
            yield {c: part.column(c) for c in columns} | {name: sent.value.probability(np.array(sums), np.array(words))}

    return map_arrow(df, run, T.StructType([*df.schema, T.StructField(name, T.DoubleType())])), name
