"""Jaccard join, quality rules, toxicity and decontamination against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from guardframe.llm import decontaminate, jaccard, quality, queries, toxicity, words
from guardframe.llm.common import table
from tests.llm import brute

ODD = [(900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, "One two"), (900_005, "one TWO"), (900_006, "Éa b\u0085c d"), (900_007, "word " * 30_000)]
SCHEMA = "doc_id long, text string, n int, keys string, score double"


def docs_of(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_jaccard(spark, sf):
    rows = docs_of(spark, sf)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard_join(spark, sf).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_groups(spark):
    """Chains of edits, a large group of near copies, outliers of it, and odd rows."""
    rnd = random.Random(3)
    rows, doc = list(ODD), 0
    for size in (12, 25, 60, 150, 700):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for group in range(40 if size == 150 else 12):
            w = list(base)
            for _ in range(rnd.randrange(size // 20 + 2)):
                w[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
            if group % 5 == 0:
                base = w
            rows.append((doc, " ".join(w)))
            doc += 1
    frame = spark.createDataFrame([(a, b, 1, "k", 0.5) for a, b in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame).collect()}
    assert got == brute.jaccard(rows)
    same = spark.createDataFrame([(3, "a b c d", 1, "k", 0.5)] * 3 + [(None, "a b c d", 1, "k", 0.5), (None, None, 1, "", None)], SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.link(same).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3), (3, 3)]
    assert jaccard.link(frame.filter("false")).count() == 0


def thue(n, first="a"):
    """Thue-Morse words: pairs of them have equal polynomials modulo any power of two."""
    text, other = first, "b" if first == "a" else "a"
    while len(text) < n:
        text += text.translate(str.maketrans(first + other, other + first))
    return text


def test_colliding_words(spark):
    """Words and lines that collide modulo 2**64 whatever the base is."""
    rows = []
    for n in (1024, 4096):
        x, y = thue(n), thue(n, "b")
        rows += [(10 * n + i, t) for i, t in enumerate((f"one {x} two", f"one {y} two", f"{x}\n{y}\n{x}", " ".join([x, y] * 12), " ".join([y, x] * 12), " ".join([x] * 30)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame).collect()} == brute.jaccard(rows)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(frame, None).collect()}
    assert got == {i: brute.statistics(t) for i, t in rows}


def test_exact_where_hashes_collide(monkeypatch):
    """Counts stay right if all hashes are equal."""
    monkeypatch.setattr(words.Ranges, "__call__", lambda self, start, end: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(words, "sequences", lambda words, start, count, size: np.zeros(len(start), np.uint64))
    texts = ["ab cd\nab ce\nab cd\n", "a b c d e f g h " * 2 + "x y", "a b c d e f g h i j k l"]
    counts = quality.count_block(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(counts[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.statistics(t)


def test_jaccard_templates(spark):
    """Short texts from one template, none similar enough, and some true pairs between them."""
    rnd = random.Random(8)
    rows = [(i, f"thank you for your order it will be sent soon number {i} to box {rnd.randrange(10**6)} x{i} y{i}") for i in range(20_000)]
    base = "thank you for your order it will be sent soon number 7 " + " ".join(f"z{i}" for i in range(40))
    rows += [(50_000, base), (50_001, base + " more"), (50_002, base + " less of it")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in jaccard.link(frame).collect()}
    assert got == {i: 50_000 if i >= 50_000 else i for i, _ in rows}


def test_rarest_shingles(spark, monkeypatch):
    """The last round alone finds all links too."""
    monkeypatch.setattr(jaccard, "CENTRES", (1, 1))
    rnd = random.Random(4)
    rows, doc = [], 0
    for size in (14, 40, 120):
        for _ in range(6):
            base = [f"w{rnd.randrange(30)}" for _ in range(size)]
            for _ in range(12):
                w = list(base)
                for _ in range(rnd.randrange(size // 12 + 2)):
                    w[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
                rows.append((doc, " ".join(w)))
                doc += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame).collect()} == brute.jaccard(rows)


def test_parity_bound():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        x = rnd.integers(0, 2**63, rnd.integers(1, 400), dtype=np.uint64)
        y = np.concatenate([x[rnd.integers(0, len(x)) :], rnd.integers(0, 2**63, rnd.integers(0, 30), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        h = int(np.bitwise_count(jaccard.parity(x, 9) ^ jaccard.parity(y, 9)).sum())
        assert h <= len(np.setxor1d(x, y))
        for percent in (80, 90):
            if len(y) and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) and not np.array_equal(x, y):
                assert set(jaccard.chunk_keys(x, percent).tolist()) & set(jaccard.chunk_keys(y, percent).tolist())


def test_quality(spark, sf):
    docs = dict(docs_of(spark, sf))
    judged = queries.op4_quality_rules(spark, sf).collect()
    assert len(judged) == len(docs)
    for r in judged:
        n, chars, symbols, dup, rep = brute.statistics(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)


def test_quality_held_out(spark):
    """Verdicts on labels that the trees didn't see; the base rule may reject what a label calls good."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").filter("quality IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    judged = quality.judge(docs, quality.fit(docs, labels.filter(~held))).join(labels.filter(held).select("doc_id", "quality"), "doc_id")
    rows = [(r.quality, r.kept) for r in judged.filter("NOT base_failed").select("quality", "kept").collect()]
    hit = sum(bool(q) and k for q, k in rows)
    assert len(rows) > 300 and hit / sum(q for q, _ in rows) >= 0.9 and hit / sum(k for _, k in rows) >= 0.9


def test_quality_edges(spark):
    rows = [*ODD, (1, "a\na\n\n\na \n" * 30), (1, "a\na\n\n\na \n" * 30), (None, "x")]
    frame = spark.createDataFrame([(a, b, 1, "k", 0.5) for a, b in rows], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(frame, quality.fit(frame, labels)).collect()
    want = sorted((i or -1, *brute.statistics(t)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality.judge(frame.filter("false"), None).count() == 0


def test_trees():
    rnd = np.random.default_rng(5)
    x = rnd.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) - 0.5 * x[:, 2] + 0.1 * rnd.standard_normal(3000) > 0.3).astype(float)
    forest = quality.train(x[:2000], y[:2000], [1, 0, -1])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.88
    grid = np.repeat(rnd.random((50, 3)), 20, axis=0)
    grid[:, 2] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(forest.score(grid).reshape(50, 20), axis=1) <= 1e-12).all()


def test_toxicity(spark):
    """Accuracy on labels that the learner never sees."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    hit = sum(y and p for y, p in held)
    recall, precision = hit / sum(y for y, _ in held), hit / max(1, sum(p for _, p in held))
    print("held out", len(held), "recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.9


def test_toxicity_edges(spark):
    assert toxicity.fold("An 1D10T, аnd Stüpid!! l⁠oser @ss $cum") == " an idiot and stüpid loser ass scum "
    lexicon = toxicity.Lexicon({" idiot": 4.0, " scu": 3.0}, frozenset({" scuba "}), -3.0, 2.0, 1.0)
    assert lexicon.score("you 1diots") > 0.9 and lexicon.score("a scuba dive") < 0.1 and lexicon.score(None) == lexicon.score("")
    phrase = toxicity.Lexicon({" trash ": 4.0, " scu": 3.0}, frozenset({" trash can ", " scuba "}), -3.0, 2.0, 1.0)
    assert phrase.score("the trash can is full") < 0.1 and phrase.score("you trash can go") < 0.1 and phrase.score("you are trash, can go trash") > 0.9
    said = [(i, f"put it in the trash can number w{i}") for i in range(30)] + [(100 + i, f"you are trash w{i} and more trash") for i in range(30)]
    learned = toxicity.learn(spark.createDataFrame(said, "doc_id long, text string"), spark.createDataFrame([(i, int(i >= 100)) for i, _ in said], "doc_id long, toxic int"))
    assert learned.score("so it is in the trash can") < 0.3 < learned.score("trash, all of you are trash")
    frame = spark.createDataFrame([(a, b, 1, "k", 0.5) for a, b in ODD], SCHEMA)
    none = toxicity.learn(frame, spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int"))
    scored, name = toxicity.score(frame, none)
    assert max(r[name] for r in scored.collect()) < 0.01
    assert toxicity.score(frame.filter("false"), none)[0].count() == 0


def test_decontaminate(spark, sf):
    items = [tuple(r) for r in table(spark, sf, "benchmark").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op8_benchmark_decontamination(spark, sf).collect()}
    assert got == brute.decontaminate(docs_of(spark, sf), items)


def test_decontaminate_edges(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    items = [(i, say(rnd.choice([1, 3, 5, 7, 9, 10, 11, 14, 25]) + (i % 7 > 0) * 6)) for i in range(60)] + [(70, None), (71, " ,"), (72, "a  A-a")]
    docs = [(i, say(rnd.randrange(60))) for i in range(150)] + ODD
    frame = spark.createDataFrame([(a, b, 1, "k", 0.5) for a, b in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 60):  # one automaton, several and items in pieces
        got = {r[0]: tuple(r)[1:] for r in decontaminate.report(*decontaminate.find(frame, bench, shard_words=size)).collect()}
        assert got == brute.decontaminate(docs, items)
    assert decontaminate.find(frame.filter("false"), bench)[0].count() == 0
    assert not any(r.contaminated for r in decontaminate.report(*decontaminate.find(frame, bench.filter("false"))).collect())
    item = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame([(1, f"Start, {item.upper()}! " + "end " * 30), (2, item), (3, "clean"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in decontaminate.clean(frame, bench).collect()}
    assert kept == {1: "Start, ! " + "end " * 30, 3: "clean", 4: None}
    # an item without an id hits as well, but isn't listed; repeated items count once
    odd = spark.createDataFrame([(None, item), (5, item + " more"), (5, item + " more")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(*decontaminate.find(frame, odd)).collect()}
    assert got[1].n_hit == 10 and got[1].n_items == 1 and got[1].items_sha256 == brute.sha("5") and got[2].contaminated
    got = {r.doc_id: r for r in decontaminate.report(*decontaminate.find(frame, odd.filter("item_id IS NULL"))).collect()}
    assert got[2].n_hit == 10 and got[2].n_items == 0 and got[2].contaminated


def test_decontaminate_long_runs(spark):
    """Runs of known words that are streamed in pieces."""
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(20)] + [(90, "w1 w2 w3 w4")]
    docs = []
    for d in range(30):
        w = rnd.choices(vocab, k=rnd.randrange(900, 1100))
        for at in (250, 256, 505, 700):
            w[at : at + 12] = items[rnd.randrange(20)][1].split()[7:19]
        docs.append((d, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.report(*decontaminate.find(frame, spark.createDataFrame(items, "item_id long, text string"))).collect()}
    assert got == brute.decontaminate(docs, items)
