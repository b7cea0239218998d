"""Plain single-machine versions of the operators' contracts, for comparison."""

import base64
import hashlib
import re
import zlib


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def chats(rows):
    """rows: (conv_id, turn, role, text)"""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out


def warc(rows):
    """rows: (page_id, html)"""
    first = {}
    for page, html in rows:
        first[html or ""] = min(page, first.get(html or "", page))
    return {p: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if first[h or ""] == p else ("revisit", first[h or ""]))) for p, h in rows}


def tokens(rows, tokenizer):
    import numpy as np

    start, out = 0, {}
    for doc, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


KINDS = [
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"(AKIA)([A-Z0-9]+)"),
    ("hex", r"()([0-9a-f]+)"),
]


def secrets(text):
    spans = []
    for k, (kind, rx) in enumerate(KINDS):
        for m in re.finditer(rx, text or ""):
            if len(m[2]) >= {"assign": 8, "access": 12, "hex": 32}[kind]:
                spans.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def jaccard(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    ids = sorted(sets, key=lambda d: len(sets[d]))
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 10 * len(sets[a]) < 9 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    top = components(ids, links)
    return {d: (len(sets[d]), top[d]) for d in ids}


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def decontaminate(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, got = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    got |= x
        out[doc] = (len(w), len(hit), len(got), sha(",".join(sorted(map(str, got)))), bool(hit))
    return out


def substrings(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                hit[i : i + length] = b"\x01" * length
            else:
                seen.add(w)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out[doc] = (len(raw), sum(hit), spans, sha(bytes(b for b, h in zip(raw, hit, strict=True) if not h)))
    return out


def hit_words(text, items, length=10):
    """The number of words of a text and the numbers of those within a window of an item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    key = id(items)
    if key not in WINDOWS:
        WINDOWS[key] = {tuple(w[i : i + length]) for _, t in items for w in [split(t)] for i in range(max(len(w) - length + 1, min(len(w), 1)))}
    w, windows = split(text), WINDOWS[key]
    return len(w), {i + k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}


WINDOWS = {}


def without_words(text, places):
    """The text without runs of the given words and what stands between the words of a run."""
    out, at, last = "", 0, None
    for k, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")):
        if k in places:
            if last != k - 1:
                out += text[at : m.start()]
            at, last = m.end(), k
    return out + (text or "")[at:] if places else text
