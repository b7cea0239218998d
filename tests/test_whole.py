"""Leak queries over whole texts against a plain version."""

import re

from guardframe.plans import planted, registry

SPACE = "[\\t-\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def leak(output, prompt, size=4, threshold=0.7, w=0.25, text="[REDACTED]"):
    """leaked, confidence, fragments, sanitized."""
    words = lambda t: re.findall("[a-z0-9_]+", t.lower())
    ot, pt = words(output), words(prompt)
    if len(pt) < 2:
        return False, 0.0, [], output
    n = min(size, max(2, len(pt)))
    s = min(3, max(1, n - 1))
    grams = lambda t, k: {" ".join(t[i : i + k]) for i in range(len(t) - k + 1)}

    def fragments(k, known):
        out = []
        for i in range(len(ot) - k + 1):
            gram = " ".join(ot[i : i + k])
            if gram in known and not any(gram in f for f in out):
                out.append(" ".join(ot[i : i + k + 4]))
        return out

    pg, og = grams(pt, n), grams(ot, n)
    f, sf = fragments(n, pg), fragments(s, grams(pt, s)) if s >= 2 else []
    overlap = len({*ot} & {*pt}) / len({*ot} | {*pt})
    conf = min(1.0, len(og & pg) / len(pg) * 2 + (0.2 if len(f) > 2 else 0)) if f else min(1.0, overlap * 2) if overlap >= w else 0.0
    leaked = bool((f and conf >= threshold) or len(f) >= 2 or (len(sf) >= 3 and overlap >= w) or (overlap >= w * 1.5 and sf))
    found = list(dict.fromkeys(f + sf)) if leaked else []
    for x in found:
        parts = x.split(" ")
        for k in range(len(parts), n - 1, -1):
            output = re.sub(SPACE.join(parts[:k]), lambda _: text, output, flags=re.I)
    return leaked, conf, found, output


def test_whole_leaks(spark, sf):
    pairs = {r.doc_id: (r.output, r.prompt) for r in planted.pairs(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in planted.documents(spark, sf).collect()}
    said = {r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'system'").collect()}
    assert set(pairs) == set(docs) and {p for _, p in pairs.values()} <= said
    for doc, (output, prompt) in pairs.items():  # no text is cut
        half = len(docs[doc]) // 2
        assert docs[doc][:half] in output and docs[doc][half:] in output, doc
    want = {doc: leak(*x) for doc, x in pairs.items()}
    got = {r.doc_id: (r.leaked, r.confidence, r.fragments) for r in registry.QUERIES["leak_decision"](spark, sf).collect()}
    assert got == {d: (a, round(c, 9), "|".join(f)) for d, (a, c, f, _) in want.items()} and 0 < sum(x[0] for x in want.values()) < len(want)
    late = [d for d, (o, _) in pairs.items() if want[d][3][:1080] == o[:1080] and want[d][3] != o]
    assert late  # found beyond the first characters
    clean = {r.doc_id: r.sanitized for r in registry.QUERIES["whole_redact"](spark, sf).collect()}
    assert clean == {d: x[3] for d, x in want.items()}
    objects = {r.doc_id: (r.had_leak, r["query"], r.note, r.named) for r in registry.QUERIES["whole_sanitize_object"](spark, sf).collect()}
    assert objects == {d: (x[0], x[3], x[3], x[3] + "|fine") for d, x in want.items()}
