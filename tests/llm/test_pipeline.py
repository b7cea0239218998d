"""The pipeline against plain versions of its stages, and its odd rows."""

import random

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from guardframe.llm import decontaminate, jaccard, secrets, toxicity
from guardframe.llm.common import materialize, row_key, table
from tests.llm import brute


def grouped(rows, size, percent):
    """The smallest id of each document's component; ``rows``: (id, text)."""
    import re

    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", brute.lower(text))
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids, links = list(sets), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    return brute.components(ids, links)


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if lexicon.score(r.text) < toxicity.CUTOFF]
    top = grouped(rows, 5, 80)
    rows = [(d, t) for d, t in rows if top[d] == d]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    kept = []
    for d, t in rows:
        n, places = brute.hit_words(t, items)
        if len(places) <= 0.5 * n:
            kept.append((d, brute.without_words(t, places)))
    lib, want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), {}
    for d, t in kept:
        for a, b in reversed(secrets.merged((a, b) for _, a, b, _, _ in secrets.find(t))):
            t = t[:a] + corpus_pipeline.BLANK + t[b:]
        want[d] = lib.encode(t)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_odd_rows(spark, sf):
    """Null and repeated ids, null texts and clashing names go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids int, key string, _gf_row int, spans int"
    said = " ".join(f"w{i}" for i in range(80))
    rows = [(1, said, "en", "a", 9, 1, "k", 1, 1), (1, said, "en", "a", 9, 1, "k", 1, 1), (None, said + " more", "en", None, 9, 1, "k", 1, 1), (None, None, None, None, None, 1, "k", 1, 1), (7, "", "en", "a", 0, 1, "k", 1, 1), (8, "token = abcdefgh12 here", "en", "a", 0, 1, "k", 1, 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = materialize(stage(spark, docs, sf), "t")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        texts = sorted(r.text or "" for r in docs.collect())
        assert texts == (["", "", "[SECRET] here", said + " more"] if n else [])  # of equals the first stays, nulls come first
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(texts)


def test_secrets_of_odd_ids(spark, sf):
    """Repeated and null ids over several partitions, with and without a column of the inner row's name."""
    rows = [(i % 7 or None, f"{'x ' * (i % 5)}token = abcdefgh{i:02} here" if i % 3 else f"nothing to see in text {i}, which is long enough to be cut") for i in range(60)]
    want = sorted(f"{'x ' * (i % 5)}[SECRET] here" if i % 3 else t for i, (_, t) in enumerate(rows))
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for frame in (docs, docs.withColumn("_gf_row", F.lit(3)), docs.withColumn("_gf_spans", F.lit(3))):
            got = corpus_pipeline.stage_secrets(spark, frame, sf)
            assert sorted(r.text for r in got.collect()) == want and got.columns == frame.columns
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = secrets.scan(docs.withColumn("_gf_row", F.length("text")), keep=["_gf_row"])
    assert sorted(r._gf_row for r in kept.collect()) == sorted(len(t) for _, t in rows)


def test_near_copies_at_eighty(spark):
    rnd = random.Random(5)
    rows, doc = [], 0
    for size in (8, 30, 90, 400):
        base = [f"w{rnd.randrange(4000)}" for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(size // 15 + 2)):
                w[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
            rows.append((doc, " ".join(w)))
            doc += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.link(frame, size=5, percent=80).collect()}
    assert got == grouped(rows, 5, 80)
    assert row_key(frame, "doc_id")[1] == "doc_id"
