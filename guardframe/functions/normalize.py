"""Normalization before detection: undo look-alikes, hidden characters, spacing, leetspeak, misspellings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce
from unicodedata import normalize as composed

from pyspark.sql import Column, DataFrame, functions as F

from guardframe.functions.literals import holds_any
from guardframe.functions.text import SPACE_CHARS, SPACES, ascii_only, bound, chars_replaced, collapse, holds_text, inner, nfkc, trim

# What is folded, removed, decoded and repaired, in this order.
HOMOGLYPHS = ("аеорсхіӏ", "aeopcxid")
INVISIBLE = "[\\u200B-\\u200F\\u2028-\\u202F\\uFEFF\\u2060]"
INVISIBLE_CHARS = "".join(map(chr, (*range(0x200B, 0x2010), *range(0x2028, 0x2030), 0xFEFF, 0x2060)))
#: White space that NFKC leaves as it is, but the plain one.
SPACES_LEFT = "".join(c for c in SPACE_CHARS if c != " " and composed("NFKC", c) == c)
LEET_SEQUENCES = [("|\\|", "n"), ("|_|", "u"), ("|v|", "m"), ("|<", "k"), ("|{", "k"), ("|2", "r"), ("|)", "d"), ("|=", "f"), ("|*", "p"), ("//\\\\", "m"), ("\\/\\/", "w"), ("\\/", "v"), ("><", "x")]
#: One of these is in every sequence, and they are rare.
LEET_SIGNS = ("|", "\\", "><")
LEET = ("013456789@$!", "oieasgtbgasi")
TYPOS = [("ingnore", "ignore"), ("ignor", "ignore"), ("ign0re", "ignore"), ("previ0us", "previous"), ("previus", "previous"), ("instrucions", "instructions"), ("instrucion", "instruction"), ("overide", "override"), ("overrride", "override"), ("disreguard", "disregard"), ("disrega", "disregard")]
PHONETICS = [("ignorre?", "ignore"), ("ign?r", "ignore"), ("pr[3e]vious", "previous"), ("instr(?:uk|uc)tions?", "instructions"), ("overryde", "override"), ("d[i1]sregard", "disregard"), ("promt", "prompt"), ("rulz", "rules")]
#: Literals one of which every word holds that a repair looks for; and such as it changes in small letters.
HELD = {p: ([p], [p]) for p, _ in TYPOS} | {
    "ignorre?": (["ignorr"], ["ignorr"]), "ign?r": (["ignr", "igr"], ["ignr", "igr"]), "pr[3e]vious": (["previous", "pr3vious"], ["pr3vious"]), "instr(?:uk|uc)tions?": (["instruk", "instruct"], ["instruk", "instruct"]),
    "overryde": (["overryde"], ["overryde"]), "d[i1]sregard": (["sregard"], ["d1sregard"]), "promt": (["promt"], ["promt"]), "rulz": (["rulz"], ["rulz"]),
}


def held(pairs: list[tuple[str, str]], lowered: bool) -> list[list[str]]:
    """What every word that a repair changes holds, for each of ``pairs``; ``lowered`` texts are in small letters."""
    return [HELD[p][lowered] for p, _ in pairs]


@dataclass(frozen=True)
class Normalization:
    """Which steps run; ``enabled`` False leaves trimming only."""

    enabled: bool = True
    fold_homoglyphs: bool = True
    strip_invisible: bool = True
    collapse_whitespace: bool = True
    join_separated_letters: bool = True
    normalize_case: bool = True
    decode_leetspeak: bool = True
    repair_typos: bool = True
    repair_phonetics: bool = True

    @classmethod
    def of(cls, options: Normalization | dict | bool | None) -> Normalization:
        """From None (defaults), False (off), a dict of steps, or itself."""
        if isinstance(options, cls):
            return options
        if options is False:
            return cls(enabled=False)
        known = {f.name for f in fields(cls)}
        if unknown := set(options or {}) - known if isinstance(options, dict) else set():
            raise ValueError(f"unknown steps {sorted(unknown)}")
        return cls(**(options if isinstance(options, dict) else {}))


def fold_homoglyphs(text: Column) -> Column:
    """Full-width letters are folded by NFKC already; the rest is one to one."""
    full = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
    plain = "".join(chr(c - 0xFEE0) for c in map(ord, full))
    return F.translate(text, full + HOMOGLYPHS[0], plain + HOMOGLYPHS[1])


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def char_maps(o: Normalization) -> tuple[tuple[str, str], tuple[str, str]]:
    """What is done to single characters before letters are joined, as two texts (characters without a counterpart go): of
    ASCII texts, and of others after NFKC, which has full-width letters and most white space folded."""
    to = dict(zip(*HOMOGLYPHS)) if o.fold_homoglyphs else {}
    gone = INVISIBLE_CHARS if o.strip_invisible else ""
    if o.collapse_whitespace:
        to |= {c: " " for c in SPACES_LEFT if c not in gone}
    few = {c: x for c, x in to.items() if c.isascii()}
    return ("".join(few), "".join(few.values())), ("".join(to) + gone, "".join(to.values()))


def fold_chars(text: Column, o: Normalization) -> Column:
    """Look-alikes, hidden characters and white space in one pass over the text."""
    plain, every = (chars_replaced(text, *m) if m[0] else text for m in char_maps(o))
    return F.when(ascii_only(text), plain).otherwise(every)


def single_spaces(text: Column) -> Column:
    """Runs of plain spaces as one."""
    return F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


#: A space between single word characters.
LONE_SPACE = r" (?=\w(?!\w))(?<=(?<!\w)\w )"


def join_letters(text: Column, single: bool = False) -> Column:
    """Single word characters with white space between become one word; ``single`` where all of it is single spaces."""
    return F.regexp_replace(text, LONE_SPACE if single else rf"(?![!-~])(?<=(?<!\w)\w){SPACES}(?=\w(?!\w))", "")


def decode_leet(text: Column, gated: bool = False) -> Column:
    decoded = text
    for sequence, letter in LEET_SEQUENCES:
        decoded = F.replace(decoded, F.lit(sequence), F.lit(letter))
    if gated:
        decoded = F.when(reduce(lambda a, b: a | b, [holds_text(text, x) for x in LEET_SIGNS]), decoded).otherwise(text)
        return chars_replaced(decoded, *LEET, given=text)
    return F.translate(decoded, *LEET)


def words_replaced(text: Column, pairs: list[tuple[str, str]], gated: bool = False, lowered: bool = False) -> Column:
    """Whole words by their repairs, one after another; every pattern is of word characters.

    Gated, a text is only searched for words whose letters it holds.
    """
    repair = lambda x, pattern, to: F.regexp_replace(x, rf"(?i)(?<!\w)(?:{pattern})(?!\w)", to)
    holds = lambda x, literals: holds_any(x if lowered else F.lower(x), literals)
    repaired, letters = text, held(pairs, lowered)
    for (pattern, to), some in zip(pairs, letters, strict=True):
        repaired = bound(repaired, lambda x: F.when(holds(x, some), repair(x, pattern, to)).otherwise(x)) if gated else repair(repaired, pattern, to)
    return F.when(holds(text, sum(letters, [])), repaired).otherwise(text) if gated else repaired


def steps(options: Normalization | dict | bool | None = None, gated: bool = False) -> list[Callable[[Column], Column]]:
    """What to apply in order.  Gated steps skip costly work but name their input more than once, so
    they belong in projections of their own."""
    o = Normalization.of(options)
    if not o.enabled:
        return [trim]
    repairs = [
        (o.normalize_case, F.lower), (o.decode_leetspeak, lambda x: decode_leet(x, gated)),
        (o.repair_typos, lambda x: words_replaced(x, TYPOS, gated, o.normalize_case)), (o.repair_phonetics, lambda x: words_replaced(x, PHONETICS, gated, o.normalize_case)),
    ]
    if gated:  # repairs make no white space
        every = [(True, lambda x: nfkc(x, True)), (any(m[0] for m in char_maps(o)), lambda x: fold_chars(x, o)), (o.collapse_whitespace, single_spaces),
                 (o.join_separated_letters, lambda x: join_letters(x, o.collapse_whitespace)), *repairs, (True, trim)]
    else:
        every = [(True, nfkc), (o.fold_homoglyphs, fold_homoglyphs), (o.strip_invisible, strip_invisible), (o.collapse_whitespace, collapse),
                 (o.join_separated_letters, join_letters), *repairs, (o.collapse_whitespace, collapse), (True, trim)]
    return [step for on, step in every if on]


def normalize(text: Column, options: Normalization | dict | bool | None = None) -> Column:
    """One expression of all steps."""
    for step in steps(options):
        text = step(text)
    return text


def normalized(df: DataFrame, text_col: str = "text", out: str = "norm", options: Normalization | dict | bool | None = None) -> DataFrame:
    """``df`` with a column ``out``; each step is a projection of its own and skips texts it can't change."""
    name = inner(df)("norm")
    rows = df.withColumn(name, F.col(text_col))
    for step in steps(options, gated=True):
        rows = rows.withColumn(name, step(F.col(name)))
    return rows.withColumn(out, F.col(name)).drop(name)
