"""Suffix-array dedup and SentencePiece against plain versions."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from guardframe.llm import pieces, queries, substrings
from guardframe.llm.common import table
from tests.llm import brute


def documents(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_substrings(spark, sf):
    got = {r[0]: tuple(r)[1:] for r in queries.op6_suffix_array_dedup(spark, sf).collect()}
    assert got == brute.substrings(documents(spark, sf))


def test_anchors_beyond_the_low_bits(monkeypatch):
    """Equal windows of one text choose one anchor, also where its places don't fit the low bits."""
    monkeypatch.setattr(substrings, "LOW", np.uint64(255))
    rnd = random.Random(3)
    shared = "".join(rnd.choices("abcdefgh", k=400))
    text = shared + "".join(rnd.choices("abcdefgh", k=3001)) + shared + "".join(rnd.choices("abcdefgh", k=90)) + shared
    found = substrings.anchors(pa.array([text, shared]))
    chosen = {}
    for row, anchor, start, n in zip(found["row"], found["anchor"], found["start"], found["windows"], strict=True):
        for i in range(start, start + n):
            chosen.setdefault((text, shared)[row][i : i + 100], []).append(anchor)
    assert sum(map(len, chosen.values())) == len(text) + len(shared) - 198
    assert max(map(len, chosen.values())) == 4 and all(len(set(x)) == 1 for x in chosen.values())


def test_very_long_text(spark):
    """One text of over 2**24 bytes that repeats a passage there."""
    rnd = np.random.default_rng(6)
    raw = bytearray(rnd.integers(97, 123, 17_600_000, dtype=np.uint8).tobytes())
    raw[17_500_000:17_500_400] = raw[17_000_000:17_000_400]
    raw[17_000_399 + 1], raw[17_500_400] = 65, 66  # the repeat ends there, and begins here
    raw[16_999_999], raw[17_499_999] = 65, 66
    text = raw.decode()
    frame = spark.createDataFrame([(1, text), (2, text[100:260])], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.report(substrings.repeated(frame)).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (400, 1, brute.sha(bytes(raw[:17_500_000] + raw[17_500_400:])))
    assert (got[2].n_removed, got[2].n_spans) == (160, 1)


def test_common_anchors(spark, monkeypatch):
    """Anchors dealt by context give the same result, also where every one is."""
    monkeypatch.setattr(substrings, "PART", 1)
    monkeypatch.setattr(substrings, "CROWD", 3)
    line = "a very common line that stands in all the texts of this little corpus "
    rnd = random.Random(7)
    rows = [(i, f"{rnd.random()} {line * (1 + i % 3)}{rnd.choice(['x', 'yy', line])} {rnd.random()}" * (1 + i % 2)) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert len(substrings.common_anchors(frame.withColumnRenamed("doc_id", "key"))) > 0
    assert {r[0]: tuple(r)[1:] for r in substrings.report(substrings.repeated(frame)).collect()} == brute.substrings(rows)


def made(seed):
    rnd = random.Random(seed)
    say = lambda n: "".join(rnd.choice(["ab", "é", "the ", "\n", "x😀"]) for _ in range(n))
    shared = [say(n) for n in (20, 60, 80, 400)]
    rows = [(i, say(rnd.randrange(60)) + rnd.choice(shared) + say(rnd.randrange(9)) + rnd.choice(shared)) for i in range(60)]
    edited = [(100 + i, shared[3][: 3 * i] + "#" + shared[3][3 * i + 1 :]) for i in range(40)]
    return [*rows, *edited, (200, "For " * 900), (201, "For " * 900), (202, "or F" * 300), (203, ""), (204, None), (205, "z" * 99), (206, "z" * 99), (207, "z" * 5000)]


def test_substring_edges(spark, monkeypatch):
    schema = "doc_id long, text string, key int, start int"
    for crowd in (substrings.CROWD, 5):  # dealt by anchor, and crowded anchors window by window
        monkeypatch.setattr(substrings, "CROWD", crowd)
        rows = made(crowd)
        frame = spark.createDataFrame([(a, b, 1, 1) for a, b in rows], schema)
        got = {r[0]: tuple(r)[1:] for r in substrings.report(substrings.repeated(frame)).collect()}
        assert got == brute.substrings(rows)
    text = "".join(map(str, range(200)))
    twice = spark.createDataFrame([(1, text, 1, 1), (1, text, 1, 1), (None, text, 1, 1)], schema)
    assert sorted(r.n_removed for r in substrings.report(substrings.repeated(twice)).collect()) == [0, len(text), len(text)]
    assert substrings.report(substrings.repeated(frame.filter("false"))).count() == 0


def test_separated():
    rnd = np.random.default_rng(4)
    raw = np.concatenate([rnd.integers(97, 99, 4000), np.tile(rnd.integers(97, 100, 300), 3)]).astype(np.uint8)
    order, apart = substrings.separated(raw)
    data = raw.tobytes()
    for i in range(1, len(raw)):
        a, b = data[order[i - 1] :][:100], data[order[i] :][:100]
        assert apart[i] == (a != b)


def test_sentencepiece(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = dict(documents(spark, sf))
    for r in queries.op7_sentencepiece(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.text_chars, r.text_crc32) == (len(texts[r.doc_id]), zlib.crc32(texts[r.doc_id].encode()))


def message(*fields):
    """A serialized message of (number, value)."""
    out = b""

    def number(x):
        parts = b""
        while x > 127:
            parts, x = parts + bytes([x & 127 | 128]), x >> 7
        return parts + bytes([x])

    for n, v in fields:
        if isinstance(v, int):
            out += number(n << 3) + number(v)
        elif isinstance(v, float):
            out += number(n << 3 | 5) + struct.pack("<f", v)
        else:
            out += number(n << 3 | 2) + number(len(v)) + v
    return out


def written_model(texts, kind=1, rules=b"identity", pieces_of=900):
    """A model file written by hand: the commonest parts of words with the logarithm of their counts."""
    counts = Counter("▁" + w[i:j] if not i else w[i - 1 : j - 1] for t in texts for w in t.split() for i in range(len(w) + 1) for j in range(i + 1, min(len(w) + 1, i + 6) + 1))
    known = sorted({c for p in counts for c in p}) + [p for p, _ in counts.most_common(pieces_of) if len(p) > 1]
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256)), *((p, math.log(counts[p] + 1) - 15 - i / 1000, 1) for i, p in enumerate(known))]
    body = message(*((1, message((1, p.encode()), (2, score), (3, t))) for p, score, t in rows))
    return body + message((2, message((3, kind), (35, 1))), (3, message((1, rules), (3, 1), (4, 0), (5, 1))))


def test_unigram(spark, sf, tmp_path):
    """For a unigram model no path has a better sum of scores, and ids decode to the text."""
    texts = [t for _, t in documents(spark, sf)][:120] + [None, "", "a  b\n 😀", "unbroken" * 4000]
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as out:
        out.write(written_model([t for t in texts[:80] if t]))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = pieces.Codec(path)
    assert pieces.trained_as(lib) == "unigram" and not codec.model.merges
    ids, at = codec.encode(texts)
    worth = lambda x: sum(lib.get_score(i) for i in x)
    for k, text in enumerate(texts):
        got, want = ids[at[k] : at[k + 1]].tolist(), lib.encode(text or "")
        assert abs(worth(got) - worth(want)) <= 1e-3 * (1 + abs(worth(want)) / 1000) and lib.decode(got) == lib.decode(want)
    for kind, rules in ((3, b"identity"), (1, b"nmt_nfkc")):
        with open(path, "wb") as out:
            out.write(written_model(["some words"], kind, rules))
        with pytest.raises(ValueError):
            pieces.trained_as(sentencepiece.SentencePieceProcessor(model_file=path))


def test_sentencepiece_edges(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    letters = [p for p in (lib.id_to_piece(i) for i in range(300, 32000, 7)) if "▁" not in p]
    texts = [None, "", " ", "  a  b\n\n c ﬁ ", "\x00\t\r\n😀日本語", "a" * 3000, " " * 500, "<s></s><unk>", *("".join(rnd.choice([*letters, " ", "  ", "\n"]) for _ in range(60)) for _ in range(300))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    encoded, name = pieces.encode(frame, path)
    assert {r.doc_id: r[name] for r in encoded.collect()} == {i: lib.encode(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text_crc32 for r in pieces.summary(encoded, name, path).collect()} == {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}
    marks = spark.createDataFrame([(1, "a▁b"), (2, " ▁ x")], "doc_id long, text string")  # the mark itself comes back as a space
    encoded, name = pieces.encode(marks, path)
    assert {r.doc_id: r[name] for r in encoded.collect()} == {1: lib.encode("a▁b"), 2: lib.encode(" ▁ x")}
    assert [r.text_crc32 for r in pieces.summary(encoded, name, path).orderBy("doc_id").collect()] == [zlib.crc32(b"a b"), zlib.crc32(b"   x")]
    codec = pieces.codec(path)
    assert codec.decode(lib.encode("a  é\x00")) == "a  é\x00"
    assert pieces.encode(frame.filter("false"), path)[0].count() == 0
