"""Normalization, detection, leak sanitizing and hardening as temporary functions of a session's SQL.

A function is one expression of built-in functions, so Catalyst sees through it: no Python, no shuffle.  What names
its input more than once is a function of its own (``…_step_…``), whose argument Spark binds in a projection.
Results equal those of ``normalized``, ``detect_columns``, ``leak_columns`` and ``harden`` with the same options,
which are resolved when the functions are made; functions of several options live side by side under prefixes.
A function in SELECT and in WHERE is worked out twice: filter over a subquery that names it once.

Defined cases: a null or empty text is not detected and normalizes to itself; a null output or prompt, or an empty
one, leaks nothing, and a null output is sanitized to an empty text; a null prompt stays null when hardened.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from guardframe.functions import catalog
from guardframe.functions.detect import MATCHES, RESULT, DetectOptions, group_hit, looked_for
from guardframe.functions.harden import HardenOptions, block
from guardframe.functions.jsregex import translate
from guardframe.functions.leak import EXTRA, LEAK, LeakOptions, beginning_sql, first_words, fragments_of_sql, hits_sql, joined_sql, overlap_sql, plain_sql, redact_sql
from guardframe.functions.literals import Found, holds_any_sql
from guardframe.functions.normalize import LEET, LEET_SEQUENCES, LEET_SIGNS, LONE_SPACE, PHONETICS, TYPOS, Normalization, char_maps, held
from guardframe.functions.text import ASTRAL, SPACE_CHARS, SPACES, chars_replaced_sql, holds_text_sql, ngrams_sql, text_sql as q

ASCII = "octet_length(t) = length(t)"
TEXTS = "cast(array() as array<string>)"


class Maker:
    """Makes functions in one session, under one prefix."""

    def __init__(self, spark: SparkSession, prefix: str):
        if not prefix.isidentifier():
            raise ValueError(f"{prefix!r} can't begin a function's name")
        self.spark, self.prefix = spark, prefix

    def make(self, name: str, arguments: str, returns: str, body: str) -> str:
        name = self.prefix + name
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
        return name

    def step(self, name: str, body: str, argument: str = "t string", returns: str = "string") -> str:
        return self.make(f"step_{name}", argument, returns, body)


def prefix_sql(limit: int | None) -> str:
    """``limit`` UTF-16 units of ``t``; half a surrogate pair at the end goes.  Without a ``limit`` all of it."""
    if limit is None:
        return "t"
    few = f"substring(t, 1, {limit})"
    whole = "if(length(d) >= 4 AND substring(d, -4, 4) BETWEEN 'D800' AND 'DBFF', substring(d, 1, length(d) - 4), d)"
    units = f"get(transform(array(hex(substring(encode({few}, 'UTF-16BE'), 1, {2 * limit}))), d -> decode(unhex({whole}), 'UTF-16BE')), 0)"
    return f"CASE WHEN octet_length(t) <= {limit} THEN t WHEN NOT {ASCII} AND rlike({few}, {q(ASTRAL)}) THEN {units} ELSE {few} END"


def replaced(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)})"


def folded(o: Normalization) -> str:
    """As ``fold_chars``."""
    plain, every = (chars_replaced_sql("t", *m) if m[0] else "t" for m in char_maps(o))
    return f"if({ASCII}, {plain}, {every})"


def decoded() -> str:
    """Signs of several characters first; only where one can be."""
    signs = "t"
    for sequence, letter in LEET_SEQUENCES:
        signs = f"replace({signs}, {q(sequence)}, {q(letter)})"
    some = " OR ".join(holds_text_sql("t", x) for x in LEET_SIGNS)
    return chars_replaced_sql(f"if({some}, {signs}, t)", *LEET, given="t")


def repaired(pairs: list[tuple[str, str]], lowered: bool) -> str:
    out, letters = "t", held(pairs, lowered)
    holds = lambda x, literals: holds_any_sql(x if lowered else f"lower({x})", literals)
    for (pattern, to), some in zip(pairs, letters, strict=True):
        repair = replaced("x", rf"(?i)(?<!\w)(?:{pattern})(?!\w)", to)
        out = f"get(transform(array({out}), x -> if({holds('x', some)}, {repair}, x)), 0)"
    return f"if({holds('t', sum(letters, []))}, {out}, t)"


def normalizing(maker: Maker, options: Normalization | dict | bool | None, text: str) -> str:
    """The call of all steps upon the SQL ``text``; makes a function for each step."""
    o = Normalization.of(options)
    trim = ("trim", True, f"btrim(t, {q(SPACE_CHARS)})")
    steps = [
        ("nfkc", True, f"if(t IS NULL OR {ASCII}, t, java_method('com.ibm.icu.text.Normalizer', 'compose', t, true))"), ("chars", any(m[0] for m in char_maps(o)), folded(o)),
        ("spaces", o.collapse_whitespace, f"if(contains(t, '  '), {replaced('t', ' {2,}', ' ')}, t)"),
        ("join", o.join_separated_letters, replaced("t", LONE_SPACE if o.collapse_whitespace else rf"(?![!-~])(?<=(?<!\w)\w){SPACES}(?=\w(?!\w))", "")), ("lower", o.normalize_case, "lower(t)"),
        ("leet", o.decode_leetspeak, decoded()), ("typos", o.repair_typos, repaired(TYPOS, o.normalize_case)), ("phonetics", o.repair_phonetics, repaired(PHONETICS, o.normalize_case)), trim,
    ]
    for name, on, body in steps if o.enabled else [trim]:
        if on:
            text = f"{maker.step(name, body)}({text})"
    return text


def settled_sql(value: str) -> str:
    """As ``settled``: filters above are not pushed through, where they would repeat the whole expression."""
    return f"if(spark_partition_id() >= 0, {value}, NULL)"


def gate_sql(found: Found, low: str) -> str:
    """Whether low-risk rules are tried, over the parameters ``norm`` and ``keys``."""
    signal = " OR ".join(f"({found.maybe('keys', [x])} AND {holds_text_sql(low, x)})" for x in catalog.SIGNALS)
    bag = f"size(filter(array_remove(split(lower(norm), {q(chr(92) + 'W+')}), ''), w -> w IN ({', '.join(map(q, catalog.SUSPICIOUS))}))) >= 2"
    structure = f"(contains(norm, '[') OR contains(norm, '<!--')) AND rlike(norm, {q(translate(catalog.STRUCTURE))})"
    return f"coalesce({signal} OR ({found.maybe('keys', catalog.SUSPICIOUS)} AND {bag}) OR ({structure}), false)"


def detecting(maker: Maker, options: DetectOptions) -> None:
    """``detect(text)``: a struct of detected, risk and matches."""
    o = options
    if o.secondary:
        raise ValueError("a second detector works on rows: use detect_columns")
    groups, levels = catalog.effective(o.threshold, o.exclude, o.custom)
    scan = maker.step("scan", f"if(t = '', NULL, {prefix_sql(o.scanned)})")
    norm, n = normalizing(maker, o.normalization, f"{scan}(txt)"), Normalization.of(o.normalization)
    low, gated = "norm" if n.enabled and n.normalize_case else "lower(norm)", any(g.risk == "low" for g in groups)
    found = looked_for(groups)
    table = f"map({', '.join(f'{q(c)}, {v}' for c, v in levels.items())})" if levels else "cast(map() as map<string,int>)"
    level = f"array_max(transform(matches, m -> coalesce(element_at({table}, m.category), 0)))"
    risk = f"element_at(array({', '.join(map(q, catalog.RISKS))}), greatest({level}, 1) + 1)"
    bounded = maker.step("bounded", f"lower({prefix_sql(o.max_input_length)})")
    phrases = [f"contains({bounded}(txt), {q(p.lower())})" for p in o.allow if p]
    hit = "size(matches) > 0" + "".join(f" AND NOT {p}" for p in phrases)
    nothing = f"named_struct('detected', false, 'risk', 'none', 'matches', cast(array() as {MATCHES}))"
    result = f"if({hit}, named_struct('detected', true, 'risk', {risk}, 'matches', matches), {nothing})"
    critical = f"array({', '.join('true' if g.risk == 'critical' else 'false' for g in groups)})" if groups else "cast(array() as array<boolean>)"
    last = f"coalesce(array_min(transform(hits, (m, i) -> if(m IS NOT NULL AND get({critical}, i), i, NULL))), {len(groups)})"
    # within a higher-order function: as generated code so many regular expressions exceed one method
    given = f"array(named_struct('norm', norm, 'raw', cast({low} as binary), 'keys', keys, 'plain', octet_length(norm) = length(norm), 'gate', gate))"
    tried = f"get(transform({given}, s -> array({', '.join(group_hit(found, g, n) for g in groups)})), 0)" if groups else f"cast(array() as {MATCHES})"
    # each one calls the next
    done = maker.step("result", settled_sql(result), f"txt string, matches {MATCHES}", RESULT)
    upto = maker.step("upto", f"{done}(txt, filter(hits, (m, i) -> m IS NOT NULL AND i <= end))", f"txt string, hits {MATCHES}, end int", RESULT)
    ended = maker.step("end", f"{upto}(txt, hits, {last})", f"txt string, hits {MATCHES}", RESULT)
    rules = maker.step("rules", f"{ended}(txt, {tried})", f"txt string, norm string, keys {found.kind}, gate boolean", RESULT)
    gate = maker.step("gate", f"{rules}(txt, norm, keys, {gate_sql(found, low) if gated else 'false'})", f"txt string, norm string, keys {found.kind}", RESULT)
    keys = maker.step("keys", f"{gate}(txt, norm, {found.sql(low)})", "txt string, norm string", RESULT)
    maker.make("detect", "txt string", RESULT, f"{keys}(txt, {norm})")


def leaking(maker: Maker, o: LeakOptions) -> None:
    """``leak(output, prompt)``: a struct of leaked, confidence, fragments and sanitized; ``sanitize(output, prompt)``: the text.

    Each stage is a function of all values so far, which adds some and calls the next one.
    """
    bounded = maker.step("output", prefix_sql(o.max_output_length))
    words = lambda t: f"array_remove(split(lower({t}), {q(chr(92) + 'W+')}), '')"
    given, w, stages = "(output <> '' AND prompt <> '')", o.word_overlap_threshold, []

    def stage(**more: tuple[str, str]) -> None:
        stages.append(more)

    stage(said=("string", f"if({given}, {bounded}(output), coalesce(output, ''))"), pt=("array<string>", f"if({given}, {words('prompt')}, {TEXTS})"))
    stage(plain=("string", f"if(size(pt) >= 2, {plain_sql('said')}, '')"), n=("int", f"least({o.ngram_size}, greatest(2, size(pt)))"))
    stage(words=("string", f"if(size(pt) >= 2, {joined_sql('said', 'plain')}, '')"), s=("int", "least(3, greatest(1, n - 1))"))
    stage(pg=("array<string>", ngrams_sql("pt", "n")), sg=("array<string>", f"if(s >= 2 AND size(pt) >= s, {ngrams_sql('pt', 's')}, {TEXTS})"))
    stage(hits=("array<string>", hits_sql("words", "if(size(sg) > 0, sg, pg)", "if(size(sg) > 0, s, n)", f"(n + {EXTRA})")))
    stage(at=("array<string>", beginning_sql("hits", "pg", "n")))
    stage(f=("array<string>", fragments_of_sql("at", "n")), sf=("array<string>", f"if(size(sg) > 0, {fragments_of_sql('hits', 's')}, {TEXTS})"),
          common=("int", f"size(array_distinct(transform(at, w -> {first_words('w', 'n')})))"))
    stage(overlap=("double", f"if(size(f) >= 2, 0D, {overlap_sql('words', 'pt', w)})"))
    ratio = "if(size(pg) > 0, common / size(pg), 0D)"
    found = f"CASE WHEN size(pt) < 2 THEN 0D WHEN size(f) > 0 THEN least(1D, {ratio} * 2 + if(size(f) > 2, 0.2D, 0D)) WHEN overlap >= {w!r}D THEN least(1D, overlap * 2) ELSE 0D END"
    stage(conf=("double", found))
    leaked = f"(size(f) > 0 AND conf >= {o.threshold!r}D) OR size(f) >= 2 OR (size(sf) >= 3 AND overlap >= {w!r}D) OR (overlap >= {w * 1.5!r}D AND size(sf) >= 1)"
    stage(leaked=("boolean", f"coalesce(size(pt) >= 2 AND ({leaked}), false)"))
    stage(every=("array<string>", f"if(leaked, array_union(f, sf), {TEXTS})"))
    clean = "said" if o.detect_only else f"if(leaked, {redact_sql('said', 'plain', 'every', 'n', o)}, said)"
    fields = [(k, kind) for more in stages for k, (kind, _) in more.items()]
    declared = lambda n: ", ".join(f"{k} {kind}" for k, kind in fields[:n])
    result = f"named_struct('leaked', leaked, 'confidence', conf, 'fragments', every, 'sanitized', {clean})"
    call = maker.step("leak", settled_sql(result), declared(len(fields)), LEAK)
    for k in range(len(stages) - 1, 0, -1):  # a function can only name those that are there
        before = [x for more in stages[:k] for x in more]
        call = maker.step(f"leak{k}", f"{call}({', '.join([*before, *(body for _, body in stages[k].values())])})", declared(len(before)), LEAK)
    leak = maker.make("leak", "output string, prompt string", LEAK, f"{call}({', '.join(body for _, body in stages[0].values())})")
    maker.make("sanitize", "output string, prompt string", "string", f"{leak}(output, prompt).sanitized")


ALL = ("normalize", "detect", "leak", "harden")


def create_functions(spark: SparkSession, prefix: str = "guard_", detect: DetectOptions | None = None, leak: LeakOptions | None = None, harden: HardenOptions | None = None, only: tuple[str, ...] = ALL) -> None:
    """Makes ``normalize(txt)``, ``detect(txt)``, ``leak(output, prompt)`` with ``sanitize(output, prompt)``, and ``harden(prompt)``, names after ``prefix``.

    They last as long as the session; made again, they are replaced.  Making ``detect`` takes some seconds: ``only`` names what is wanted.
    """
    if unknown := set(only) - set(ALL):
        raise ValueError(f"unknown functions {sorted(unknown)}")
    maker, d, h = Maker(spark, prefix), detect or DetectOptions(), harden or HardenOptions()
    if "normalize" in only:
        maker.make("normalize", "txt string", "string", normalizing(maker, d.normalization, "txt"))
    if "detect" in only:
        detecting(maker, d)
    if "leak" in only:
        leaking(maker, leak or LeakOptions())
    if "harden" in only:
        text = f"concat({q(block(h) + chr(10) * 2)}, prompt)" if h.position == "prepend" else f"concat(prompt, {q(chr(10) + block(h))})"
        maker.make("harden", "prompt string", "string", text)
