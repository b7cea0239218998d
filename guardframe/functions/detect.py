"""Detection of prompt injection: an ordered rule catalog over normalized text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from guardframe.functions import catalog
from guardframe.functions.jsregex import beyond_ascii, branches, first_of_line, lowered, plain_branches, required_sets, translate
from guardframe.functions.literals import Found, key
from guardframe.functions.normalize import Normalization, steps
from guardframe.functions.text import ascii_only, bytes_sql, holds_text_sql, inner, settled, text_sql, tokens, utf16_prefix

SCAN_LIMIT = 8192
INPUT_LIMIT = 1024 * 1024
MATCHES = "array<struct<category:string,pattern:string,confidence:double>>"
RESULT = f"struct<detected:boolean,risk:string,matches:{MATCHES}>"


@dataclass(frozen=True)
class DetectOptions:
    threshold: str = "medium"
    normalization: Normalization | dict | bool | None = None
    custom: tuple[catalog.Group, ...] = ()
    exclude: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    #: UTF-16 units of a text, None: all; of these, ``scan_limit`` are normalized and matched.
    max_input_length: int | None = INPUT_LIMIT
    #: From the rows with their detection to a Column of what replaces it where something was detected (null keeps it).
    secondary: Callable[[DataFrame], Column] | None = field(default=None, compare=False)
    scan_limit: int | None = SCAN_LIMIT

    @property
    def scanned(self) -> int | None:
        return min((x for x in (self.max_input_length, self.scan_limit) if x is not None), default=None)


#: Texts are read to their end.
WHOLE = DetectOptions(max_input_length=None, scan_limit=None)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def prefilter(text: Column) -> Column:
    """Whether any signal occurs, in either case."""
    low = F.lower(text)
    return any_of([low.contains(s) for s in catalog.SIGNALS])


def token_bag(text: Column) -> Column:
    """How many words of the text are suspicious."""
    return F.size(F.filter(tokens(text), lambda w: w.isin(catalog.SUSPICIOUS)))


def suspicious_structure(text: Column) -> Column:
    return text.rlike(translate(catalog.STRUCTURE))


def low_risk_gate(text: Column) -> Column:
    """Whether low-risk rules are tried at all."""
    return prefilter(text) | (token_bag(text) >= 2) | suspicious_structure(text)


def looked_for(groups: list[catalog.Group]) -> Found:
    """Pieces of what every match of a rule holds, and of what opens the gate of low-risk rules."""
    sets = {r.source: [tuple(x.lower() for x in s) for s in required_sets(r.source)[:3]] for g in groups for r in g.rules}
    rules = Counter(k for found in sets.values() for k in {key(x)[:5] for s in found for x in s})
    # of a rule's sets, the one whose literals other rules hold as well
    told = {source: min(found, key=lambda s: (sum(1 / rules[key(x)[:5]] for x in s), -min(map(len, s)))) for source, found in sets.items() if found}
    return Found([*(x for s in told.values() for x in s), *(catalog.SIGNALS + catalog.SUSPICIOUS if any(g.risk == "low" for g in groups) else ())], told)


def gate_if_found(text: str, low: str, seen: str, found: Found) -> Column:
    """As ``low_risk_gate``; each of its parts is tried only where what it needs may occur.  Arguments are SQL."""
    signal = " OR ".join(f"({found.maybe(seen, [x])} AND {holds_text_sql(low, x)})" for x in catalog.SIGNALS)
    words = F.expr(found.maybe(seen, catalog.SUSPICIOUS)) & (token_bag(F.expr(text)) >= 2)
    return F.expr(signal) | words | (F.expr(f"contains({text}, '[') OR contains({text}, '<!--')") & suspicious_structure(F.expr(text)))


#: What may stand first in a match and may as well not: whether there is one doesn't depend on it.
OPTIONAL = re.compile(r"\\\[\?\\s\*(?![?+*{])")


def rule_hit(found: Found, rule: catalog.Rule, lower: bool, spaced: bool) -> str:
    """The regular expression, tried where one of each set of literals that every match holds occurs.

    SQL over the struct ``s`` of norm, raw (norm in small letters, as bytes), keys and plain; ``lower`` where norm is in small letters,
    ``spaced`` where its white space is single spaces.
    """
    held = lambda literals: "(" + " OR ".join(f"contains(s.raw, {bytes_sql(x.lower())})" for x in literals) + ")"
    guards = [found.maybe("s.keys", found.told[rule.source])] if rule.source in found.told else []
    guards += map(held, required_sets(rule.source, spaced))
    if beyond_ascii(rule.source):
        guards.append("NOT s.plain")
        if not rule.flags and (each := plain_branches(rule.source)):
            return " AND ".join([*guards, "(" + " OR ".join(f"contains(s.norm, {text_sql(x)})" for x in each) + ")"])
    first = OPTIONAL.match(rule.source) if len(branches(rule.source)) == 1 else None
    source = rule.source[first.end() if first else 0 :]
    small = lowered(source) if rule.flags == "i" and lower else None  # begun by letters, this is found faster
    pattern = first_of_line(translate(small) if small else translate(source, ignore_case=rule.flags == "i"), small or source)
    return " AND ".join([*guards, f"rlike(s.norm, {text_sql(pattern)})"])


def group_hit(found: Found, group: catalog.Group, n: Normalization) -> str:
    """SQL of the first rule of the group that matches, as a match struct, or null."""
    lower, spaced = n.enabled and n.normalize_case, n.enabled and n.collapse_whitespace
    match = lambda rule: f"named_struct('category', {text_sql(group.category)}, 'pattern', {text_sql(rule.source[:60])}, 'confidence', {group.confidence!r}D)"
    cases = " ".join(f"WHEN {rule_hit(found, rule, lower, spaced)} THEN {match(rule)}" for rule in group.rules)
    return f"IF(s.gate, CASE {cases} END, NULL)" if group.risk == "low" else f"CASE {cases} END"


def detect_columns(df: DataFrame, text_col: str = "text", options: DetectOptions | None = None, out: str = "detection") -> DataFrame:
    """``df`` with a column ``out``: struct of detected, risk and matches.  No row is shuffled.

    Each step of normalization has a projection of its own where it names its input more than once.
    All groups are tried within one higher-order function: as generated code so many regular
    expressions exceed what the JVM compiles as one method.
    """
    o = options or DetectOptions()
    groups, levels = catalog.effective(o.threshold, o.exclude, o.custom)
    text, name = F.col(text_col), inner(df)
    norm, seen, hits, end, matches = map(name, ("norm", "seen", "hits", "last", "matches"))
    scanned = utf16_prefix(text, o.scanned)
    rows = df.withColumn(norm, F.when(text.isNotNull() & (text != ""), scanned))
    for step in steps(o.normalization, gated=True):
        rows = rows.withColumn(norm, step(F.col(norm)))
    n, x = Normalization.of(o.normalization), F.col(norm)
    low, gated = norm if n.enabled and n.normalize_case else f"lower({norm})", any(g.risk == "low" for g in groups)
    found = looked_for(groups)
    rows = rows.withColumn(seen, found.column(F.expr(low)))
    gate = gate_if_found(norm, low, seen, found) if gated else F.lit(False)
    rows = rows.withColumn(seen, F.struct(x.alias("norm"), F.expr(low).cast("binary").alias("raw"), F.col(seen).alias("keys"), ascii_only(x).alias("plain"), gate.alias("gate")))
    # in SQL text: made in Python, the rules' expressions cost seconds for each plan
    tried = F.expr(f"transform(array({seen}), s -> array({', '.join(group_hit(found, g, n) for g in groups)}))")
    rows = rows.withColumn(hits, F.get(tried, F.lit(0)) if groups else F.array().cast(MATCHES))
    # the scan ends after the first critical match: what stands later is not reported
    critical = F.array(*(F.lit(g.risk == "critical") for g in groups)) if groups else F.array().cast("array<boolean>")
    last = F.array_min(F.transform(hits, lambda m, i: F.when(m.isNotNull() & F.get(critical, i), i)))
    rows = rows.withColumn(end, F.coalesce(last, F.lit(len(groups))))
    rows = rows.withColumn(matches, settled(F.filter(hits, lambda m, i: m.isNotNull() & (i <= F.col(end)))))
    hit = F.size(matches) > 0
    if phrases := [p for p in o.allow if p]:
        bounded = F.lower(utf16_prefix(text, o.max_input_length))
        hit &= ~any_of([bounded.contains(p.lower()) for p in phrases])
    table = F.create_map(*(F.lit(x) for pair in levels.items() for x in pair)) if levels else F.create_map().cast("map<string,int>")
    level = F.array_max(F.transform(matches, lambda m: F.coalesce(F.element_at(table, m["category"]), F.lit(0))))
    # a category that only has rules without a risk of its own reports the lowest
    risk = F.element_at(F.array(*map(F.lit, catalog.RISKS)), F.greatest(level, F.lit(1)) + 1)
    result = F.when(hit, F.struct(F.lit(True).alias("detected"), risk.alias("risk"), F.col(matches).alias("matches"))).otherwise(neutral())
    rows = rows.withColumn(out, result).drop(norm, seen, hits, end, matches)
    return override(rows, out, o.secondary) if o.secondary else rows


def neutral() -> Column:
    return F.struct(F.lit(False).alias("detected"), F.lit("none").alias("risk"), F.array().cast(MATCHES).alias("matches"))


def override(rows: DataFrame, out: str, secondary: Callable[[DataFrame], Column]) -> DataFrame:
    """Let ``secondary`` look at detected rows again; where it says nothing the result stays."""
    again = F.when(F.col(out)["detected"], secondary(rows).cast(RESULT))
    return rows.withColumn(out, F.coalesce(again, F.col(out)))


def categories(result: Column) -> Column:
    return F.transform(result["matches"], lambda m: m["category"])


def flat(result: Column) -> list[Column]:
    """detected, risk and matches as text (category|pattern, joined by ';') and the least confidence."""
    matches = F.array_join(F.transform(result["matches"], lambda m: F.concat(m["category"], F.lit("|"), m["pattern"])), ";")
    least = F.array_min(F.transform(result["matches"], lambda m: m["confidence"]))
    return [result["detected"].alias("detected"), result["risk"].alias("risk"), matches.alias("matches"), F.coalesce(least, F.lit(0.0)).alias("least_confidence")]
