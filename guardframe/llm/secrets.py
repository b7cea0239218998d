"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every whole text.  The hash of each candidate's value is counted over
the corpus by distinct repositories and owners, first the repositories of each owner, then the owners.
Values that more than ``OWNERS`` owners hold are copied examples, and so are values of at least two owners
in more than ``REPOS`` repositories; what one owner holds, in however many repositories, or few hold in few
places, is a live-looking credential.  Where no column names the repository, equal texts are one.  The base kinds (assign, access, hex) are always
reported; spans of the further kinds are added only where their value is owner-specific, and may
reach over a base span that holds a part of them.

Defined cases: a null text is empty and has no spans; a null repository or owner counts as one
of its own name ''; repeated rows and null ids are rows like others (the work goes by an
internal row key); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from guardframe.llm.common import blocks, free_name, map_arrow, materialize

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of hex digits is matched whole, so shorter ones may be skipped at once
ASSIGN_MIN, ACCESS_MIN = 8, 16
#: Further kinds, each with substrings one of which every match holds.
MORE = [
    ("private_key", ("-----BEGIN ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.*?-----END (?:[A-Z]+ )*PRIVATE KEY-----", re.S)),
    ("jwt", ("eyJ",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("url_login", ("://",), re.compile(r"(?<=://)[^\s:/@]*+:[^\s:/@]{3,}+(?=@)")),
    ("prefixed", ("ghp", "gho", "ghu", "ghs", "ghr", "sk_live", "rk_live", "sk_test", "glpat", "xox"), re.compile(r"(?:gh[pousr]|sk_live|rk_live|sk_test|glpat|xox[abprs])[_-][A-Za-z0-9_-]{16,}")),
]
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{24,}")
KINDS = ("assign", "access", "hex", *(k for k, _, _ in MORE), "random")
OWNERS = 2
REPOS = 10
BLOCK_BYTES = 4 << 20
SPAN = "struct<kind:string,start:int,end:int,hash:string,base:boolean>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Digits, capitals and small letters mixed without the repetition of words or paths."""
    return any(c.isdigit() for c in value) and any("A" <= c <= "Z" for c in value) and any("a" <= c <= "z" for c in value) and entropy(value) >= 3.8


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint intervals that cover the same places, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the disjoint intervals holds all of a to b."""
    at = bisect.bisect_right(taken, (a, math.inf))
    return at > 0 and taken[at - 1][1] >= b


def meets(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the disjoint intervals holds a place of a to b."""
    at = bisect.bisect_left(taken, (b,))
    return at > 0 and taken[at - 1][1] > a


def find(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, base) of every candidate, by start, then kind as listed."""
    found = []
    low = text.lower() if "=" in text or ":" in text else ""
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end(), m[2], True) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [("hex", m.start(), m.end(), m[0], True) for m in HEX.finditer(text)]
    # a candidate is left out only where spans so far hold all of it; a random one also within a further kind
    taken, further = merged(x[1:3] for x in found), []
    for kind, parts, rx in MORE:
        if any(part in text for part in parts):
            new = [(kind, m.start(), m.end(), m[0], False) for m in rx.finditer(text) if not covered(taken, *m.span())]
            further += new
            taken = merged([*taken, *(x[1:3] for x in new)])
    apart = merged(x[1:3] for x in further)
    found += further
    found += [("random", m.start(), m.end(), m[0], False) for m in RANDOM.finditer(text) if looks_random(m[0]) and not covered(taken, *m.span()) and not meets(apart, *m.span())]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: str, only_base: bool = False) -> Column:
    text = f"transform({f'filter({spans}, s -> s.base)' if only_base else spans}, s -> concat(s.kind, ':', s.start, ':', s.end))"
    return F.expr(f"array_join({text}, ',')")


def scan(df: DataFrame, text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", owners: int = OWNERS, repos: int = REPOS, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of each row plus ``spans`` and ``shared`` (hashes of values that are copied examples).

    Each span has kind, start, end (code points, end exclusive), hash and base.
    """
    keep = keep or ["doc_id"]
    # inner names, none of which is a kept column's
    text_in, repo, owner, held, row, span, digest, wide_in, shared_in = (free_name(keep, f"_gf_{n}") for n in ("text", "repo", "owner", "spans", "row", "span", "hash", "wide", "shared"))
    named = lambda col, name: (F.coalesce(F.col(col).cast("string"), F.lit("")) if col else F.lit("")).alias(name)
    work = df.select(*keep, F.col(text_col).alias(text_in), named(repo_col, repo), named(owner_col, owner))
    out = T.StructType([f for f in work.schema if f.name != text_in] + [T.StructField(held, T.ArrayType(T.StructType.fromDDL("kind string, start int, end int, hash string, base boolean")))])

    def find_all(batch: pa.RecordBatch):
        for part in blocks(batch, text_in, BLOCK_BYTES):
            spans, repo_of = [], part.column(repo).to_pylist()
            for i, scalar in enumerate(part.column(text_in)):
                text = scalar.as_py() or ""
                got = find(text)
                spans.append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest(), "base": base} for k, a, b, v, base in got])
                if got and not repo_col:
                    repo_of[i] = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
            yield {n: part.column(n) for n in out.names if n != held} | {held: spans, repo: repo_of}

    rows = materialize(map_arrow(work, find_all, out).withColumn(row, F.monotonically_increasing_id()), "candidates")
    each = rows.filter(F.size(held) > 0).select(row, repo, owner, F.explode(held).alias(span)).withColumn(digest, F.col(span)["hash"])
    wide = materialize(spread(each.select(digest, repo, owner), digest, repo, owner).filter((F.col("owners") > owners) | (F.col("owners") > 1) & (F.col("repos") > repos)).select(digest), "shared")
    marked = each.join(wide.withColumn(wide_in, F.lit(True)), digest, "left")
    hit = marked.filter(wide_in).groupBy(row).agg(F.collect_set(digest).alias(shared_in))
    both = rows.join(hit, row, "left").withColumn(shared_in, F.coalesce(shared_in, F.array().cast("array<string>")))
    spans = F.expr(f"filter({held}, s -> s.base OR NOT array_contains({shared_in}, s.hash))")
    return both.select(*keep, spans.alias("spans"), F.col(shared_in).alias("shared"))


def spread(found: DataFrame, digest: str, repo: str, owner: str) -> DataFrame:
    """The hash, ``owners`` and ``repos`` (repositories, those of each owner for themselves) of every value.

    Each step is dealt by more than the value before the next counts its rows, so a very common value is
    a row for each owner at most when it meets in one task.
    """
    places = found.groupBy(digest, owner, repo).agg(F.lit(1).alias("one"))
    return places.groupBy(digest, owner).agg(F.count("*").alias("n")).groupBy(digest).agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of the base spans and the text of all spans."""
    n = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)")
    live = F.expr("cast(size(filter(spans, s -> NOT array_contains(shared, s.hash))) as bigint)")
    return scanned.select(
        F.col(id_col).alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined("spans", True), 256).alias("base_sha256"), joined("spans").alias("spans"), live.alias("n_live"),
    )
