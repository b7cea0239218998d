"""Leaks of a system prompt into an output: n-gram fragments, word overlap, redaction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from guardframe.functions.jsregex import SPACE_JAVA
from guardframe.functions.text import SPACE_CHARS, SPACE_RUNS, bound_sql, holds_sql, inner, ngrams_sql, settled, text_sql, tokens, utf16_prefix

OUTPUT_LIMIT = 1024 * 1024
TEXTS = "cast(array() as array<string>)"
LEAK = "struct<leaked:boolean,confidence:double,fragments:array<string>,sanitized:string>"
REDACTED = "[REDACTED]"
EXTRA = 4  # words after an n-gram that belong to its fragment


@dataclass(frozen=True)
class LeakOptions:
    ngram_size: int = 4
    threshold: float = 0.7
    word_overlap_threshold: float = 0.25
    redaction_text: str = REDACTED
    detect_only: bool = False
    #: UTF-16 units of an output; None: all.
    max_output_length: int | None = OUTPUT_LIMIT

    def __post_init__(self):
        if self.ngram_size < 1:
            raise ValueError("ngram_size must be at least 1")

    @property
    def redaction(self) -> str:
        """The text as a replacement for Java's regular expressions, taken literally."""
        return (self.redaction_text or REDACTED).replace("\\", "\\\\").replace("$", "\\$")


def effective_size(prompt_tokens: Column, ngram_size: int) -> Column:
    return F.least(F.lit(ngram_size), F.greatest(F.lit(2), F.size(prompt_tokens)))


def small_size(effective: Column) -> Column:
    return F.least(F.lit(3), F.greatest(F.lit(1), effective - 1))


# Lambdas are written in SQL, over names of columns: made in Python they cost many calls for each plan.
def gram(words: str, i: str, n: str) -> str:
    return f"array_join(slice({words}, {i} + 1, {n}), ' ')"


def shared_places_sql(words: str, numbers: str, prompt_ngrams: str, n: str) -> str:
    """Where an n-gram of the prompt begins among ``words``.

    ``numbers`` are those of the words that the prompt has too, 0 for others: only where n words in a row have one
    is the n-gram made and compared.
    """
    places = f"if(size({words}) >= {n}, sequence(0, size({words}) - {n}), cast(array() as array<int>))"
    known = f"filter({places}, i -> get({numbers}, i) > 0 AND forall(slice({numbers}, i + 1, {n}), k -> k > 0))"
    return f"filter({known}, i -> array_contains({prompt_ngrams}, {gram(words, 'i', n)}))"


def shared_places(words: str, numbers: str, prompt_ngrams: str, n: str) -> Column:
    return F.expr(shared_places_sql(words, numbers, prompt_ngrams, n))


def fragments_at_sql(words: str, hits: str, n: str) -> str:
    """From left to right, windows of n + EXTRA words that begin at ``hits``; not where a fragment so far has
    the n-gram among its characters."""
    held = f"exists(found, f -> contains(f, {gram(words, 'i', n)}))"
    return f"aggregate({hits}, cast(array() as array<string>), (found, i) -> if({held}, found, array_append(found, {gram(words, 'i', f'{n} + {EXTRA}')})))"


def fragments_at(words: str, hits: str, n: str) -> Column:
    return F.expr(fragments_at_sql(words, hits, n))


def word_numbers_sql(words: str, shared: str) -> str:
    """The place of each word in ``shared`` (from 1), 0 where it isn't there."""
    return f"if(size({shared}) > 0, transform({words}, w -> cast(array_position({shared}, w) as int)), cast(array() as array<int>))"


def word_numbers(words: str, shared: str) -> Column:
    return F.expr(word_numbers_sql(words, shared))


ODD = "(contains({0}, '\u212a') OR contains({0}, '\u0130'))"  # letters beyond ASCII whose small form begins with an ASCII one
#: White space but the plain one and line feeds; ASCII that is no part of a word.
SPACES_LEFT = "".join(f"\\u{ord(c):04X}" for c in SPACE_CHARS if c not in " \n")
#: The same where nothing commoner stands: compared with one after another, each letter of a text would cost a hundred times as much.
SPACE_LEFT = f"(?![ -\\u009F])(?![\\u00A1-\\u167F])(?![\\u3001-\\uFEFE])[{SPACES_LEFT}]"
BETWEEN = "".join(f"\\x{c:02X}" for c in range(128) if not (chr(c).isalnum() or chr(c) in "_ "))


def plain_sql(text: str) -> str:
    """``text`` in small letters, with one space for each run of white space and ~ for other runs beyond ASCII.

    Words with white space between occur in the text, in either case, as often as they do here with spaces between.
    """
    every, few = f"regexp_replace(x, {text_sql(SPACE_RUNS)}, ' ')", "regexp_replace(x, ' {2,}', ' ')"
    one = bound_sql(f"replace({text}, '\n', ' ')", "x", f"CASE WHEN rlike(x, {text_sql(SPACE_LEFT)}) THEN {every} WHEN contains(x, '  ') THEN {few} ELSE x END")
    rest = text_sql("[^\\x00-\\x7F]+")
    return bound_sql(one, "x", f"lower(if(octet_length(x) = length(x), x, regexp_replace(x, {rest}, '~')))")


def joined_sql(text: str, plain: str) -> str:
    """The words of ``text``, as ``tokens`` has them, each between spaces."""
    words = lambda t, pattern: f"concat(' ', regexp_replace({t}, {text_sql(pattern)}, ' '), ' ')"
    return f"if({ODD.format(text)}, {words(f'lower({text})', chr(92) + 'W+')}, {words(plain, f' ?[{BETWEEN}][{BETWEEN} ]*')})"


def first_words(text: str, n: str) -> str:
    return f"substring_index({text}, ' ', {n})"


MANY = 64  # n-grams


def pattern_sql(grams: str, longest: str) -> str:
    """A pattern whose group 1 has up to ``longest`` words from where one of ``grams`` begins."""
    # before all of them are tried, the first characters are looked at one by one
    chars = lambda i: f"'[', array_join(array_distinct(transform({grams}, g -> substring(concat(g, ' '), {i}, 1))), ''), ']'"
    begun = f"if(exists({grams}, g -> length(g) < 2), concat({chars(1)}), concat({chars(1)}, {chars(2)}, {chars(3)}))"
    return f"concat(' (?=', {begun}, ')(?=(?:', array_join({grams}, '|'), ') )(?=((?:{chr(92) * 2}w++ ){{1,', {longest}, '}}+))')"


def hits_sql(joined: str, grams: str, n: str, longest: str, pattern: str | None = None) -> str:
    """From left to right, up to ``longest`` words (each with a space behind) of ``joined`` from each place where one of
    ``grams`` (of n words) begins.  Of many, those are looked for that occur; ``pattern`` is that of few, if it is there already."""
    words, found = f"split(trim({joined}), ' ')", lambda p: f"regexp_extract_all({joined}, {p}, 1)"
    made = lambda some: bound_sql(some, "gs", f"if(size(gs) > 0, {found(pattern_sql('gs', longest))}, {TEXTS})", "array<string>")
    many = made(f"array_intersect({grams}, {ngrams_sql(words, n)})")
    return f"CASE WHEN size({grams}) > {MANY} THEN {many} WHEN size({grams}) > 0 THEN {found(pattern) if pattern else made(grams)} ELSE {TEXTS} END"


def beginning_sql(hits: str, grams: str, n: str) -> str:
    """Those of ``hits`` whose first n words are one of ``grams``."""
    return f"filter({hits}, w -> array_contains({grams}, {first_words('w', n)}))"


def fragments_of_sql(hits: str, n: str) -> str:
    """As ``fragments_at_sql``, of the words at each hit."""
    held = f"exists(found, f -> contains(f, {first_words('w', n)}))"
    return f"aggregate({hits}, cast(array() as array<string>), (found, w) -> if({held}, found, array_append(found, rtrim({first_words('w', f'({n} + {EXTRA})')}))))"


def overlap_sql(joined: str, prompt_words: str, least: float) -> str:
    """The Jaccard ratio of both sets of words; 0 where it is known to be below ``least``, as the output's first words
    alone are too many."""
    every, own = f"split(trim({joined}), ' ')", f"size(array_distinct({prompt_words}))"
    share = bound_sql(f"size(array_intersect(ws, {prompt_words}))", "b", f"if(b > 0, b / (size(array_distinct(ws)) + {own} - b), 0D)", "double")
    ratio = bound_sql(every, "ws", share, "double")
    if least <= 0:
        return ratio
    few = f"(size({prompt_words}) + 1) * {max(2, int(2.5 / least))}"
    begin = f"slice(split(trim({joined}), ' ', cast({few} + 1 as int)), 1, cast({few} as int))"
    return f"if(size(array_distinct({begin})) * {least!r}D > {own} + 1, 0D, {ratio})"


def redact_sql(text: str, plain: str, found: str, least: str, options: LeakOptions) -> str:
    """Each fragment's beginnings, longest first, down to ``least`` words, out of the text.

    Beside the text goes its plain form, which tells whether a beginning occurs: regular expressions are left for
    those that do.
    """
    gap, instead, beginning, first = text_sql(f"(?-i:[{SPACE_JAVA}]+)"), options.redaction_text or REDACTED, first_words("fr", "k"), first_words("fr", least)
    cut = f"regexp_replace(st.t, concat('(?i)', replace({beginning}, ' ', {gap})), {text_sql(options.redaction)})"
    state = lambda t, j, more: f"named_struct('t', {t}, 'j', {j}, 'more', {more})"
    kind, left = "struct<t:string,j:string,more:boolean>", holds_sql("j", first)  # no longer beginning is left where the shortest is not
    if instead.isascii() and instead == " ".join(instead.split()):  # its plain form, whatever stands beside it
        after = bound_sql(f"replace(st.j, {beginning}, {text_sql(instead.lower())})", "j", state(cut, "j", left), kind)
    else:
        after = bound_sql(cut, "x", bound_sql(plain_sql("x"), "j", state("x", "j", left), kind), kind)
    shorter = f"aggregate(sequence(size(split(fr, ' ')), {least}, -1), {state('st.t', 'st.j', 'true')}, (st, k) -> if(st.more AND {holds_sql('st.j', beginning)}, {after}, st))"
    each = f"(st, fr) -> if({holds_sql('st.j', first)} AND size(split(fr, ' ')) >= {least}, {shorter}, st)"
    return f"aggregate({found}, {state(text, plain, 'true')}, {each}, st -> st.t)"


def prompt_stages(o: LeakOptions, name: Callable[[str], str]) -> list[dict[str, str]]:
    """What is worked out of the prompt's words (``pt``), in order: SQL by name."""
    pt, n, s, pg, sg = map(name, ("pt", "n", "s", "pg", "sg"))
    few = bound_sql(f"if(size({sg}) > 0, {sg}, {pg})", "gs", f"if(size(gs) BETWEEN 1 AND {MANY}, {pattern_sql('gs', f'({n} + {EXTRA})')}, '')")
    return [{"n": f"least({o.ngram_size}, greatest(2, size({pt})))"}, {"s": f"least(3, greatest(1, {n} - 1))"},
            {"pg": ngrams_sql(pt, n), "sg": f"if({s} >= 2 AND size({pt}) >= {s}, {ngrams_sql(pt, s)}, {TEXTS})"}, {"pattern": few}]


def output_stages(o: LeakOptions, name: Callable[[str], str]) -> list[dict[str, str]]:
    """What is worked out of the output (``text``) and the prompt's stages, in order.

    One pass over the output's words finds where small n-grams of the prompt begin; all else works on the few words there.
    """
    text, pt, n, s, pg, sg, pattern, plain, words, hits, at, f, sf, common, overlap, conf, leaked, found = map(name, ("text", "pt", "n", "s", "pg", "sg", "pattern", "plain", "words", "hits", "at", "f", "sf", "common", "overlap", "conf", "leaked", "all"))
    w, small = f"{o.word_overlap_threshold!r}D", f"size({sg}) > 0"  # an n-gram of the prompt begins with a small one
    ratio = f"if(size({pg}) > 0, {common} / size({pg}), 0D)"
    sure = f"least(1D, {ratio} * 2 + if(size({f}) > 2, 0.2D, 0D))"
    leaks = f"(size({f}) > 0 AND {conf} >= {o.threshold!r}D) OR size({f}) >= 2 OR (size({sf}) >= 3 AND {overlap} >= {w}) OR ({overlap} >= {o.word_overlap_threshold * 1.5!r}D AND size({sf}) >= 1)"
    return [
        {"plain": f"if(size({pt}) >= 2, {plain_sql(text)}, '')"}, {"words": f"if(size({pt}) >= 2, {joined_sql(text, plain)}, '')"},
        {"hits": hits_sql(words, f"if({small}, {sg}, {pg})", f"if({small}, {s}, {n})", f"({n} + {EXTRA})", pattern)}, {"at": beginning_sql(hits, pg, n)},
        {"f": fragments_of_sql(at, n), "sf": f"if({small}, {fragments_of_sql(hits, s)}, {TEXTS})", "common": f"size(array_distinct(transform({at}, w -> {first_words('w', n)})))"},
        {"overlap": f"if(size({f}) >= 2, 0D, {overlap_sql(words, pt, o.word_overlap_threshold)})"},  # two fragments leak whatever it is
        {"conf": f"CASE WHEN size({pt}) < 2 THEN 0D WHEN size({f}) > 0 THEN {sure} WHEN {overlap} >= {w} THEN least(1D, {overlap} * 2) ELSE 0D END"},
        {"leaked": f"coalesce(size({pt}) >= 2 AND ({leaks}), false)"}, {"all": f"if({leaked}, array_union({f}, {sf}), {TEXTS})"},
        {"clean": text if o.detect_only else f"if({leaked}, {redact_sql(text, plain, found, n, o)}, {text})"},
    ]


def leak_sql(text: str, o: LeakOptions, name: Callable[[str], str]) -> str:
    """The struct of ``leak_columns`` as one expression for use in lambdas; ``name`` names the prompt's stages.

    Stages are lambdas, one within another, so that each value is worked out once.
    """
    own = {k for stage in output_stages(o, str) for k in stage} | {"text"}
    var = lambda k: f"leak_{k}" if k in own else name(k)
    stages = [(k, body) for stage in output_stages(o, var) for k, body in stage.items()]
    out = f"named_struct('leaked', {var('leaked')}, 'confidence', {var('conf')}, 'fragments', {var('all')}, 'sanitized', {var('clean')})"
    for k, body in reversed([("text", text), *stages]):
        out = bound_sql(body, var(k), out, LEAK)
    return out


def leak_columns(df: DataFrame, output_col: str, prompt_col: str, options: LeakOptions | None = None, out: str = "leak") -> DataFrame:
    """``df`` with a struct of leaked, confidence, fragments and sanitized.  Each stage is a projection."""
    o, name = options or LeakOptions(), inner(df)
    output, prompt = F.col(output_col), F.col(prompt_col)
    given = output.isNotNull() & (output != "") & prompt.isNotNull() & (prompt != "")
    rows = df.withColumn(name("pt"), F.when(given, tokens(prompt)).otherwise(F.array().cast("array<string>")))
    for stage in prompt_stages(o, name):
        rows = rows.withColumns({name(k): F.expr(x) for k, x in stage.items()})
    return leaks_found(rows, F.when(given, utf16_prefix(output, o.max_output_length)).otherwise(F.coalesce(output, F.lit(""))), o, name, out)


def leaks_found(df: DataFrame, text: Column, options: LeakOptions, name: Callable[[str], str], out: str) -> DataFrame:
    """``df`` with the struct of ``leak_columns`` for ``text``; the prompt's stages are there and go."""
    rows, made = df.withColumn(name("text"), text), ["text", "pt", *(k for stage in prompt_stages(options, name) for k in stage)]
    for stage in output_stages(options, name)[:-1]:
        rows = rows.withColumns({name(k): settled(F.expr(x)) if k == "leaked" else F.expr(x) for k, x in stage.items()})
        made.extend(stage)
    clean = F.expr(output_stages(options, name)[-1]["clean"])
    result = F.struct(F.col(name("leaked")).alias("leaked"), F.col(name("conf")).alias("confidence"), F.col(name("all")).alias("fragments"), clean.alias("sanitized"))
    return rows.withColumn(out, result).drop(*map(name, made))


def sanitize_object(df: DataFrame, object_col: str, prompt_col: str, options: LeakOptions | None = None, leaked_out: str = "had_leak") -> DataFrame:
    """Sanitize every string value of a struct, array or map column, at any depth; keys stay.

    Each value is sanitized just as an output is, within its row.
    """
    if holds_lists(df.schema[object_col].dataType):
        return sanitize_nested(df, object_col, prompt_col, options, leaked_out)
    name, paths = inner(df), list(string_paths(df.schema[object_col].dataType))
    rows, flags, value = df, [], F.col(object_col)
    for k, path in enumerate(paths):
        leaf, found = F.col(".".join([f"`{object_col}`", *(f"`{x}`" for x in path)])), name(f"leak{k}")
        rows = leak_columns(rows.withColumn(name("leaf"), leaf), name("leaf"), prompt_col, options, found).drop(name("leaf"))
        value = value.withField(".".join(f"`{x}`" for x in path), F.when(F.col(found)["leaked"], F.col(found)["sanitized"]).otherwise(leaf))
        flags.append(F.col(found)["leaked"])
    had = reduce(lambda a, b: a | b, flags, F.lit(False))
    rows = rows.withColumns({name("value"): value, name("had"): had}).drop(*(name(f"leak{k}") for k in range(len(paths))))
    return rows.withColumns({object_col: F.col(name("value")), leaked_out: F.col(name("had"))}).drop(name("value"), name("had"))


def sanitize_nested(df: DataFrame, object_col: str, prompt_col: str, options: LeakOptions | None, leaked_out: str) -> DataFrame:
    """As ``sanitize_object``, for any nesting."""
    kind = df.schema[object_col].dataType
    texts = object_texts(F.col(object_col), kind)
    return sanitize_texts(df, object_col, prompt_col, options, leaked_out, texts, lambda value, fixes: rebuilt(value, kind, fixes))


def object_texts(value: Column, kind: T.DataType) -> Column:
    return F.filter(F.array_distinct(leaves(value, kind)), lambda x: x.isNotNull())


def prompt_columns(df: DataFrame, prompt_col: str, options: LeakOptions, name: Callable[[str], str]) -> DataFrame:
    """``df`` with what ``leak_sql`` needs of the prompt."""
    rows = df.withColumn(name("pt"), F.coalesce(tokens(F.col(f"`{prompt_col}`")), F.array().cast("array<string>")))
    for stage in prompt_stages(options, name):
        rows = rows.withColumns({name(k): F.expr(x) for k, x in stage.items()})
    return rows


def fixes_sql(texts: str, options: LeakOptions, name: Callable[[str], str]) -> str:
    """A map from those of ``texts`` (made by ``bounded``) that leak to what replaces them."""
    fix = bound_sql(leak_sql("p.text", options, name), "l", "if(l.leaked, named_struct('leaf', p.leaf, 'sanitized', l.sanitized), NULL)", "struct<leaf:string,sanitized:string>")
    return f"map_from_entries(filter(transform({texts}, p -> {fix}), x -> x IS NOT NULL))"


def bounded(texts: Column, options: LeakOptions) -> Column:
    return F.transform(texts, lambda x: F.struct(x.alias("leaf"), utf16_prefix(x, options.max_output_length).alias("text")))


def sanitize_texts(df: DataFrame, object_col: str, prompt_col: str, options: LeakOptions | None, leaked_out: str, texts: Column, rebuild: Callable[[Column, Column], Column]) -> DataFrame:
    """Sanitize ``texts`` (distinct strings of ``object_col``) within their row: no row is made or shuffled.
    ``rebuild`` makes the new value of the old one and a map from texts to what replaces them.
    """
    o, name = options or LeakOptions(), inner(df)
    empty = F.array().cast("array<struct<leaf:string,text:string>>")
    rows = prompt_columns(df, prompt_col, o, name).withColumn(name("texts"), F.coalesce(bounded(texts, o), empty))
    rows = rows.withColumn(name("fixes"), settled(F.expr(fixes_sql(name("texts"), o, name))))
    fixes, made = F.col(name("fixes")), rebuild(F.col(f"`{object_col}`"), F.col(name("fixes")))
    columns = [made.alias(c) if c == object_col else F.col(f"`{c}`") for c in df.columns if c != leaked_out]
    return rows.select(*columns, (F.size(fixes) > 0).alias(leaked_out))


#: Pieces of a JSON text that together are the text: strings (with the colon behind them, if they are names), and what is between.
JSON_PIECES = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++|")'


def json_string(piece: Column) -> Column:
    """The string that a piece of JSON stands for; null where it is none, or the name of a field."""
    value = piece.startswith('"') & piece.endswith('"') & (F.length(piece) > 1)
    return F.when(value, F.get(F.from_json(F.concat(F.lit("["), piece, F.lit("]")), "array<string>"), F.lit(0)))


def sanitize_json(df: DataFrame, json_col: str, prompt_col: str, options: LeakOptions | None = None, leaked_out: str = "had_leak") -> DataFrame:
    """Sanitize every string value of a column of JSON texts, whatever their shapes: each row may have another one.

    Values are found by their places in the text; names, numbers, white space and values that don't leak stay as
    they are written.  A text that is a lone string is one value.  Nulls and texts without strings stay; in a text that isn't JSON,
    what looks like a string value is sanitized and all else stays.
    """
    return sanitize_texts(df, json_col, prompt_col, options, leaked_out, json_texts(F.col(json_col)), json_rebuilt)


def json_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JSON_PIECES), 1)


def json_texts(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(json_pieces(text), json_string), lambda x: x.isNotNull() & (x != "")))


def json_rebuilt(text: Column, fixes: Column) -> Column:
    new = lambda p: F.try_element_at(fixes, F.coalesce(json_string(p), F.lit("")))
    written = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    return F.when(F.size(fixes) > 0, F.array_join(F.transform(json_pieces(text), lambda p: F.when(new(p).isNotNull(), written(new(p))).otherwise(p)), "")).otherwise(text)


def holds_lists(kind: T.DataType) -> bool:
    """Whether there are strings in arrays or maps."""
    if isinstance(kind, T.StructType):
        return any(holds_lists(f.dataType) for f in kind)
    return isinstance(kind, (T.ArrayType, T.MapType)) and holds_strings(kind)


def holds_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_strings(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return holds_strings(kind.elementType)
    return holds_strings(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def leaves(value: Column, kind: T.DataType) -> Column:
    """All string values, in an array."""
    none = F.array().cast("array<string>")
    if not holds_strings(kind):
        return none
    if isinstance(kind, T.StructType):
        return F.concat(*(leaves(value[f.name], f.dataType) for f in kind))
    if isinstance(kind, T.MapType):
        return leaves(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: leaves(x, kind.elementType))), none)
    return F.array(value)


def rebuilt(value: Column, kind: T.DataType, fixes: Column) -> Column:
    """``value`` with the strings that are keys of ``fixes`` replaced."""
    if not holds_strings(kind):
        return value
    if isinstance(kind, T.StructType):
        out = value
        for f in kind:
            if holds_strings(f.dataType):
                out = out.withField(f"`{f.name}`", rebuilt(value[f.name], f.dataType, fixes))
        return out
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: rebuilt(v, kind.valueType, fixes))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rebuilt(x, kind.elementType, fixes))
    return F.coalesce(F.try_element_at(fixes, value), value)


def string_paths(kind: T.DataType, path: tuple[str, ...] = ()):
    if isinstance(kind, T.StructType):
        for f in kind:
            yield from string_paths(f.dataType, (*path, f.name))
    elif isinstance(kind, T.StringType) and path:
        yield path
