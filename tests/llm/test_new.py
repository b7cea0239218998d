"""Ranked search, Merkle manifest and exact dedup against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from guardframe.llm import exact, merkle, quality, queries, ranked, registry, substrings, token_files, toxicity
from guardframe.llm.common import row_key, table


def docs_of(spark, sf, *columns):
    return [tuple(r) for r in table(spark, sf, "documents").select(*columns).collect()]


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op13_exact_dedup"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = registry.QUERIES[name](spark, sf)
    rel = con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got, want = sorted(map(tuple, df.select(columns).collect())), sorted(rel.select(", ".join(columns)).fetchall())
    assert got == want and got


# ranked search
def best(docs, items, top=10):
    """(item, rank, doc, score) by trying every pair."""
    terms = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    made = [(d, Counter(terms(t))) for d, t in docs]
    made = [(d, c) for d, c in made if c]
    n, length = len(made), sum(sum(c.values()) for _, c in made)
    df = Counter(t for _, c in made for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in made:
            m = 100 - 75 + 75 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score:
                scores.append((-score, -(2**63) if d is None else d))
        out += [(item, k + 1, None if d == -(2**63) else d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])]
    return out


def told(rows):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


WIDE = "doc_id long, text string, term string, score double, n int, no int, rank int"
ASKED = "item_id string, text string, doc_id long, no int"


def many(spark, rows):
    return spark.createDataFrame([(a, b, "t", 0.5, 1, 2, 3) for a, b in rows], WIDE)


def test_ranked_groups(spark, monkeypatch):
    """Copies, near copies and ties over several tries, in two blocks of items."""
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.7)) % 400}" for _ in range(4000)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice((1, 3, 10, 60))))) for i in range(700)]
    base = [rnd.choice(words) for _ in range(40)]
    rows += [(1000 + i, " ".join(base)) for i in range(60)]  # ties
    rows += [(2000 + i, " ".join([*base[: i % 40], "other", *base[i % 40 :]])) for i in range(60)]
    rows += [(3000, "w1 " * 5000), (None, " ".join(base)), (None, None), (3001, ""), (3002, " ,; "), (1000, " ".join(base)), (3003, "ÄÖ Äö äö Ünï 1x1")]
    items = [(f"q{i}", " ".join(rnd.choice(words) for _ in range(rnd.choice((2, 8, 30))))) for i in range(25)]
    items += [("base", " ".join(base)), ("twice", "w1 w1 W2"), ("twice", "w3"), ("none", "zzz"), ("null", None), ("empty", "--"), (None, "ÄÖ äö"), ("one", "1X1")]
    frame, asked = many(spark, rows), spark.createDataFrame([(a, b, 1, 2) for a, b in items], ASKED)
    monkeypatch.setattr(ranked, "ENTRIES", 3000)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 250)
    got = told(ranked.search(frame.repartition(5), asked).collect())
    # rows of one item id are items of their own
    assert got == sorted(best(rows, items), key=str)
    assert len([r for r in got if r[0] == "base"]) == 10 and not [r for r in got if r[0] in ("none", "null", "empty")]
    assert told(ranked.search(frame, asked, top=3).collect()) == sorted(best(rows, items, 3), key=str)
    assert ranked.search(frame.filter("false"), asked).count() == ranked.search(frame, asked.filter("false")).count() == 0
    assert ranked.search(frame, asked.filter("item_id = 'empty'")).columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_prunes():
    """Most of a trie is never entered where the best are found early."""
    import numpy as np

    rnd = random.Random(1)
    docs = [sorted(rnd.sample(range(2000), 40)) for _ in range(3000)]
    flat = np.array([t for d in docs for t in d], np.int64)
    tree = ranked.Trie(np.arange(3000), np.full(3000, 100), np.full(3000, 40), flat, np.ones(len(flat), np.int64))
    item = ranked.Best(10)
    terms = np.array(docs[7], np.int64)
    tree.search(terms, np.full(40, 1000), item)
    scores = sorted((-1000 * len({*docs[7]} & {*d}) * (10**9 // 1800), i) for i, d in enumerate(docs))
    assert item.rows == scores[:10]
    before = len(tree.nodes)
    assert before < 1200  # of some 1500 nodes there could be; made only when entered
    item = ranked.Best(1)
    tree.nodes.clear()
    tree.search(terms, np.full(40, 1000), item)
    assert item.rows == scores[:1] and len(tree.nodes) < 20


def test_terms_in_pieces(monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 7)
    text = "Ab cd-EF é" * 50 + "x" * 100 + " Ω y"
    assert [t.decode() for p in ranked.terms_of(text) for t in p] == re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))


# Merkle
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest(rows):
    """{(doc_id, leaf): report} of rows (doc_id, source, lang, n_chars, text)."""

    def climb(nodes):
        """Root, and of each node its siblings with their side (None: alone)."""
        paths, at, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
        while len(now) > 1:
            pairs = [now[i : i + 2] for i in range(0, len(now), 2)]
            for i, members in enumerate(at):
                run = pairs[i // 2]
                for x in members:
                    paths[x].append((i % 2, run[1 - i % 2]) if len(run) == 2 else None)
            at = [at[i] + (at[i + 1] if i + 1 < len(at) else []) for i in range(0, len(at), 2)]
            now = [sha(*run) for run in pairs]
        return now[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    made = {x: climb([leaf(r) for r in t]) for x, t in trees.items()}
    root, tops = climb([made[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for r, path in zip(trees[x], made[x][1], strict=True):
            path = path + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for step in path:
                h = sha(h) if step is None else sha(step[1], h) if step[0] else sha(h, step[1])
            out.append((r[0], leaf(r), made[x][0], root, sha(*(s[1] for s in path if s)), h, h == root))
    return sorted(out, key=str)


def report(frame, bits):
    columns, more = ["doc_id", "source", "lang", "n_chars", "text"], F.col("n_chars") + 1
    altered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & more.isNotNull()
    made = merkle.build(frame, columns, claimed=F.when(altered, merkle.leaf([more if c == "n_chars" else F.col(c) for c in columns])), bits=bits)
    return sorted((tuple(r) for r in merkle.verified(merkle.proofs(made, ["claimed"]), made.root).collect()), key=str)


def test_merkle(spark, sf):
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, sf).collect()), key=str)
    assert got == manifest(docs_of(spark, sf, "doc_id", "source", "lang", "n_chars", "text"))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_merkle_rounds(spark, bits):
    """Trees of several rounds, of all sizes, many groups, odd rows and clashing names."""
    rows = [(i, f"s{i % 3}", f"l{n}", i if i % 5 else None, "é" * (i % 4) if i % 6 else None) for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33) for i in range(100 * n, 100 * n + n)]
    rows += [(1, None, None, None, None), (None, "s", None, 1, "x"), (None, "s", None, 1, "x"), (2, "s", "", 1, ""), (3, "s", "", 1, ""), (3, "s", "", 1, ""), (4, "s", "é", 1, "y" * 100_000), (5, "s", "zz", 1, "-"), (6, "s", "+", 1, "1:")]
    frame = spark.createDataFrame([(*r, 1, "t", b"d", 0) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, digest binary, block int")
    assert report(frame.repartition(6), bits) == manifest(rows)
    empty = merkle.build(frame.filter("false"), ["doc_id", "text"], bits=bits)
    assert empty.root is None and merkle.proofs(empty).count() == 0


def test_merkle_one(spark):
    frame = spark.createDataFrame([(1, "s", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    assert report(frame, 12) == manifest([(1, "s", "en", 3, "abc")])


# exact dedup
def marked(rows, keep=max):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        best = keep((d for d in ids if d is not None), default=None)
        kept = False
        for d in ids:
            stays = d == best and not kept
            kept = kept or stays
            out.append((d, best, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 40}") for i in range(300)] + [(1000 + i, "hot") for i in range(1500)] + [(None, "text 3"), (None, "lone"), (None, "lone"), (5, "text 5"), (2000, None), (2001, ""), (2002, " "), (2003, "é"), (2004, "é"), (2005, "x" * 300_000), (2006, "x" * 300_000)]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, keep, weak):
    """Also with a hash that makes different texts meet."""
    frame = spark.createDataFrame([(a, b, b"h", 0, 1, "z") for a, b in ROWS], "doc_id long, text string, h binary, row int, id int, sha string").repartition(7)
    content = (lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))) if weak else exact.content_hash
    got = sorted((tuple(r) for r in exact.mark(frame, keep=keep, content=content).collect()), key=str)
    assert got == marked(ROWS, max if keep == "largest" else min)


def test_exact_rows(spark):
    frame = spark.createDataFrame([(a, b, 0, 1) for a, b in ROWS], "doc_id long, text string, id int, keep_id int")
    left = exact.dedup(frame)
    assert left.columns == frame.columns
    want = {}
    for d, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        want.setdefault(t or "", d)
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str) == sorted(((d, t) for t, d in want.items()), key=str)
    assert exact.mark(frame.filter("false")).count() == exact.dedup(frame.filter("false")).count() == 0
    with pytest.raises(ValueError):
        exact.mark(frame, keep="first")


def test_exact_is_native(spark, sf):
    """No Python in the plan; texts aren't part of what is stored or dealt but where hashes are shared."""
    plan = queries.op13_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# rows of one id, over partitions that aren't coalesced
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


@pytest.fixture
def apart(spark):
    uncoalesced(spark)
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_key_ties(apart):
    rows = [(i % 2 if i % 7 else None, f"text {i * 7919 % 101}") for i in range(400)]
    keyed, key = row_key(apart.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id")
    got = [(r.doc_id, r.text) for r in keyed.orderBy(key).collect()]
    mark = {r.text: r.m for r in keyed.select("text", F.xxhash64("text").alias("m")).distinct().collect()}
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark[r[1]], r[1])) and keyed.select(key).distinct().count() == 400


def test_token_ties(apart):
    """Starts of rows of one id don't depend on the number of partitions."""
    import public_tokenizers

    rows = [(i % 2 if i % 5 else None, f"word {'x ' * (i % 11)}{i}") for i in range(60)]
    made = []
    for n in (1, 8):
        apart.conf.set("spark.sql.shuffle.partitions", n)
        made.append(sorted((tuple(r) for r in token_files.round_trip(apart.createDataFrame(rows, "doc_id long, text string").repartition(n), public_tokenizers.path("byte_bpe_50k.json")).collect()), key=str))
    apart.conf.set("spark.sql.shuffle.partitions", 8)
    assert made[0] == made[1] and sum(r[2] for r in made[0]) == max(r[1] + r[2] for r in made[0])


def test_report_of_many_spans(spark):
    """A text with 160,000 spans takes no more than its length asks for."""
    import time

    text, n = "ab" * 4_000_000, 160_000
    spans = [(50 * i + 3, 50 * i + 40) for i in range(n)]
    frame = spark.createDataFrame([(1, text, spans), (2, "é", None), (3, "", [])], "doc_id long, text string, spans array<struct<start:int,end:int>>")
    began = time.perf_counter()
    got = {r.doc_id: tuple(r)[1:] for r in substrings.report(frame).collect()}
    assert time.perf_counter() - began < 20
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    assert got[1] == (len(text), 37 * n, n, sha(*kept, text[at:])) and got[2] == (2, 0, 0, sha("é")) and got[3] == (0, 0, 0, sha(""))


def test_sample_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"t{i % 50}") for i in range(20_000)] + [(i, "x") for i in range(2, 30)] + [(None, "y")], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 3, "doc_id long, quality int, toxic int")
    assert quality.sample_of(docs, labels, "quality", limit=25).count() <= 25
    assert quality.sample_of(docs, labels, "quality").count() == 29


def test_rare_toxic_terms(spark):
    """Terms of few documents are learned, however many others there are."""
    rnd = random.Random(4)
    plain = [f"plain{i}" for i in range(300)]
    bad = [f"q{a}{b}vex" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopq"]
    rows = [(i, " ".join([*(rnd.choice(plain) for _ in range(30)), *([bad[i // 4 % 340]] if i % 4 == 0 else [])])) for i in range(15_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = toxicity.learn(docs, spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int"))
    assert len(made.weights) > 300
    found = [made.score(f"plain1 plain2 {w} plain3") >= toxicity.CUTOFF for w in bad]
    assert sum(found[300:]) > 30 and sum(found) > 300 and made.score("plain1 plain2 plain3 plain4") < toxicity.CUTOFF
