"""Text helpers as Column expressions: ECMAScript lengths, white space, NFKC, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from guardframe.functions.jsregex import SPACE_JAVA

#: Printable ASCII but the space is let go first, before the class, which is slow, is tried.
SPACES = f"(?![!-~])[{SPACE_JAVA}]+"
#: White space of ECMAScript, character by character.
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ASTRAL = "[\\x{10000}-\\x{10FFFF}]"

def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_substring(text: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` UTF-16 units from ``start`` (0-based); halves of surrogate pairs at the ends go."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    plain = F.substring(text, start + 1, length)
    # as many code points reach as far at least
    raw = F.substring(F.encode(F.substring(text, F.lit(1), start + length), "UTF-16BE"), start * 2 + 1, length * 2)
    digits = F.hex(raw)
    tail = F.substring(digits, -4, 4).between("D800", "DBFF") & (F.length(digits) >= 4)
    head = F.substring(digits, 1, 4).between("DC00", "DFFF")
    kept = F.when(tail, F.regexp_replace(digits, "....$", "")).otherwise(digits)
    kept = F.when(head, F.regexp_replace(kept, "^....", "")).otherwise(kept)
    astral = ~ascii_only(text) & F.substring(text, F.lit(1), start + length).rlike(ASTRAL)
    return F.when(astral, F.decode(F.unhex(kept), "UTF-16BE")).otherwise(plain)


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def utf16_prefix(text: Column, length: int | None) -> Column:
    """A text has no more UTF-16 units than bytes of UTF-8; without a ``length`` all of it."""
    return text if length is None else F.when(F.octet_length(text) <= length, text).otherwise(utf16_substring(text, 0, length))


def utf16_pieces(text: str, size: int, overlap: int = 0) -> Column:
    """Structs of no, piece and before (units of overlap): UTF-16 units no * size - overlap to no * size + size of the column ``text``.

    A border within a surrogate pair stands before the pair, so no pair is cut; pieces that are empty so are left
    out.  The text is encoded once, and a piece is found by its place.
    """
    raw = f"encode({text}, 'UTF-16BE')"
    border = lambda b: f"({b} - if(s.astral AND hex(substring(s.raw, 2 * ({b}) - 1, 2)) BETWEEN 'D800' AND 'DBFF' AND {b} > 0, 1, 0))"
    units = "octet_length(s.raw) div 2"
    begin, end = border(f"greatest(0, k * {size} - {overlap})"), border(f"least({units}, k * {size} + {size})")
    own = f"{border(f'k * {size}')} < {end}"  # something but the overlap
    one = f"named_struct('no', cast(k as int), 'before', cast({border(f'k * {size}')} - {begin} as int), 'piece', if({own}, decode(substring(s.raw, cast(2 * {begin} + 1 as int), cast(2 * ({end} - {begin}) as int)), 'UTF-16BE'), ''))"
    numbers = f"if({units} > 0, sequence(0, cast(({units} - 1) div {size} as int)), cast(array() as array<int>))"
    state = f"array(named_struct('raw', coalesce({raw}, x''), 'astral', coalesce({text} rlike {text_sql(ASTRAL)}, false)))"
    return F.expr(f"filter(flatten(transform({state}, s -> transform({numbers}, k -> {one}))), p -> p.piece <> '')")


def trim(text: Column) -> Column:
    """Without ECMAScript white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


#: Runs of white space but single plain spaces.
SPACE_RUNS = f"(?![!-~])(?: [{SPACE_JAVA}]+|[{SPACE_JAVA.replace(' ', '', 1)}][{SPACE_JAVA}]*)"


def collapse(text: Column) -> Column:
    """Each run of white space as one space; single spaces are left alone."""
    return F.regexp_replace(text, SPACE_RUNS, " ")


def nfkc(text: Column, gated: bool = False) -> Column:
    """NFKC, by the ICU library that Spark ships."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNull() | ascii_only(text), text).otherwise(composed) if gated else F.when(text.isNotNull(), composed)


def chars_replaced_sql(text: str, chars: str, to: str, given: str | None = None) -> str:
    """As ``translate``, without a string and a look-up for each character; both of the basic plane only.

    ``given`` is null just where ``text`` is, if that is costly.
    """
    return f"if({given or text} IS NULL, NULL, java_method('org.apache.commons.lang3.StringUtils', 'replaceChars', {text}, {text_sql(chars)}, {text_sql(to)}))"


def chars_replaced(text: Column, chars: str, to: str, given: Column | None = None) -> Column:
    """``chars_replaced_sql`` as a Column."""
    return F.when((text if given is None else given).isNotNull(), F.java_method(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("replaceChars"), text, F.lit(chars), F.lit(to)))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of the text in small letters."""
    return F.array_remove(F.split(F.lower(text), "\\W+"), "")


def ngrams_sql(words: str, n: str) -> str:
    """As ``ngrams``, in SQL over expressions: lambdas made in Python cost many calls for each plan."""
    return f"array_distinct(transform(if(size({words}) >= {n}, sequence(0, size({words}) - {n}), cast(array() as array<int>)), i -> array_join(slice({words}, i + 1, {n}), ' ')))"


def bound_sql(value: str, name: str, body: str, kind: str = "string") -> str:
    """``body``, of type ``kind``, with ``name`` for ``value``, which is worked out once.

    Not the element that ``transform`` makes: each look at an element asks anew for the type of all lambdas within,
    which doubles with each level of them.
    """
    return f"aggregate(array({value}), cast(NULL AS {kind}), (nothing, {name}) -> {body})"


def bound(value: Column, f, kind: str = "string") -> Column:
    """``bound_sql`` as a Column: ``f`` of the name."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda nothing, x: f(x))


def text_sql(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bytes_sql(value: str) -> str:
    """A literal of the bytes of ``value``."""
    return f"X'{value.encode().hex()}'"


def holds_sql(text: str, part: str) -> str:
    """As ``contains`` of two strings, over their bytes: arrays of bytes are searched in half the time."""
    return f"contains(cast({text} as binary), cast({part} as binary))"


def holds_text_sql(text: str, part: str) -> str:
    """``holds_sql`` of a given ``part``."""
    return f"contains(cast({text} as binary), {bytes_sql(part)})"


def holds_text(text: Column, part: str) -> Column:
    """``holds_text_sql`` as a Column."""
    return F.contains(text.cast("binary"), F.lit(part.encode()))


def ngrams(words: Column, n: Column) -> Column:
    """Distinct windows of n words, in order of first occurrence."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard ratio of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def settled(value: Column) -> Column:
    """``value``, marked so that the optimizer neither copies its expression into filters above nor
    computes it twice.  Filters on other columns should come before."""
    return F.when(F.spark_partition_id() >= 0, value)


def inner(*tables: DataFrame):
    """Names for working columns: a function from a wish to a name that no column of ``tables`` begins like."""
    prefix, taken = "_gf_", [c.lower() for t in tables for c in t.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return lambda wish: prefix + wish
