"""ECMAScript regular expressions, as far as the rules use them, for other engines.

Java (Spark) and RE2 (the reference SQL) differ from ECMAScript in what ``\\s``, ``.`` and ``\\b`` mean;
these are written out.  ``\\w`` and ``\\d`` are ASCII in all three.
"""

from __future__ import annotations

import re

#: White space and line ends of ECMAScript, as the inside of a character class.
SPACE_JAVA = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_RE2 = r"\t\n\x0b\x0c\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LINE_JAVA, LINE_RE2 = r"\n\r\u2028\u2029", r"\n\r\x{2028}\x{2029}"


def translate(source: str, engine: str = "java", ignore_case: bool = False) -> str:
    """``source`` (without slashes and flags) for ``java`` or ``re2``."""
    java = engine == "java"
    space, line = (SPACE_JAVA, LINE_JAVA) if java else (SPACE_RE2, LINE_RE2)
    out, i, inside = [], 0, False
    while i < len(source):
        c = source[i]
        if c == "\\":
            e = source[i + 1]
            i += 2
            if e == "s":
                out.append(space if inside else f"[{space}]")
            elif e == "S" and not inside:
                out.append(f"[^{space}]")
            elif e == "b" and not inside and java:
                out.append(r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
            elif e == "u" and not java:
                out.append(rf"\x{{{source[i : i + 4]}}}")
                i += 4
            elif e == "/":
                out.append("/")
            else:
                out.append("\\" + e)
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "." and not inside:
            c = f"[^{line}]"
        elif c == "[" and inside:
            c = r"\["
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def first_of_line(pattern: str, source: str) -> str:
    """``pattern``, the translation of ``source`` for Java, in a form that matches the same texts; of ``A.*B`` where A is plain words,
    each line is searched for its first A and from there for B.

    Else each A is tried anew up to the line's end, which takes the square of a text that says A over and over.  The first A
    will do, as what follows a later one follows it too; A doesn't overlap itself, so over a line's end that holds as well.
    """
    begin, any_char, rest = source.partition(".*")
    plain = re.sub(r"(?<=\w)\\s\+(?=\w)", " ", begin)
    if not any_char or not re.fullmatch(r"\w+(?: \w+)*", plain) or not rest or rest[0] in "?+" or len(branches(source)) > 1:
        return pattern
    low = plain.lower()
    if any(low.startswith(low[i:]) for i in range(1, len(low))):
        return pattern
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    line = f"[^{LINE_JAVA}]*"
    first, after = pattern.removeprefix(flag).split(line, 1)
    return f"{flag}(?<!{line[:-1]})(?>{line}?{first}){line}{after}"


def lowered(source: str) -> str | None:
    """``source`` for texts in small letters, where it needs no flag "i"; None if that is not plain to see."""
    ranges = re.findall(r"(.)-(.)", "".join(re.findall(r"\[(?:\\.|[^\]\\])*\]", source)))
    if any(a.isupper() != b.isupper() for a, b in ranges) or re.search(r"\\[pPkQENc]|\(\?[^:=!]", source):
        return None
    return re.sub(r"(\\.)|([A-Z])", lambda m: m[1] or m[2].lower(), source)


def required_literals(source: str, spaced: bool = False) -> list[str]:
    """The runs of plain characters that every match holds; none of an alternation.

    ``spaced``: texts have single spaces for white space, so such a run goes on over it.
    """
    found, run, depth, i = [], "", 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            c, i = source[i : i + 2], i + 1
        plain = c if len(c) == 1 and (c.isalnum() or c in " _-:<!#;&,") else c[1] if len(c) == 2 and not c[1].isalnum() else ""
        if c == "\\\\":
            plain = "\\"
        after = source[i + 1 : i + 2]
        if spaced and c == "\\s" and after == "+":
            plain, i, after = " ", i + 1, ""
        if c == "|" and not depth:
            return []
        if c == "[":
            i = class_end(source, i)
            plain, after = "", source[i + 1 : i + 2]
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if plain and not depth and after not in ("?", "*", "{"):
            run += plain
        else:
            found.append(run)
            run = ""
        if after == "+":
            found.append(run)
            run = ""
        i += 1
    return [x for x in dict.fromkeys([*found, run]) if x]


def branches(source: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = class_end(source, i)
        elif c == "|" and not depth:
            out.append(source[start:i])
            start = i + 1
        else:
            depth += (c == "(") - (c == ")")
        i += 1
    return [*out, source[start:]]


def class_end(source: str, at: int) -> int:
    """The place of the bracket that ends the character class which begins at ``at``."""
    at += 1
    while source[at] != "]":
        at += 2 if source[at] == "\\" else 1
    return at


def groups(source: str) -> list[str]:
    """The insides of the plain groups that every match goes through."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = class_end(source, i)
        elif c == "(":
            start = i if not depth else start
            depth += 1
        elif c == ")":
            depth -= 1
            inside, after = source[start + 1 : i], source[i + 1 : i + 2]
            if not depth and after not in ("?", "*", "{") and (inside.startswith("?:") or not inside.startswith("?")):
                out.append(inside.removeprefix("?:"))
        i += 1
    return out


def useful(literal: str) -> bool:
    """Long enough to tell, or of signs alone, or behind a backslash; ASCII."""
    return literal.isascii() and (len(literal) > 2 or (len(literal) == 2 and (literal[0] == "\\" or not any(c.isalpha() or c == " " for c in literal))))


def required_sets(source: str, spaced: bool = False) -> list[tuple[str, ...]]:
    """Sets of literals; every match holds one of each set at least.  Sets of long literals come first."""
    each = branches(source)
    if len(each) > 1:
        sets = [required_sets(b, spaced)[:1] for b in each]
        return [tuple(dict.fromkeys(x for s in sets for x in s[0]))] if all(sets) else []
    found = [(x,) for x in required_literals(source, spaced) if useful(x)]
    found += [s for g in groups(source) for s in required_sets(g, spaced)]
    return sorted(dict.fromkeys(found), key=lambda s: (-min(map(len, s)), len(s)))


def plain_branches(source: str) -> list[str]:
    """The alternatives of a pattern of nothing but characters, else none."""
    return [] if re.search(r"[\\\[\](){}?*+.^$]", source) else branches(source)


def beyond_ascii(source: str) -> bool:
    """Whether every match surely holds a character beyond ASCII."""
    def one(branch: str) -> bool:
        if re.fullmatch(r"\[(?:\\u[0-9A-Fa-f]{4}-?)+\]", branch):
            return all(int(x, 16) > 127 for x in re.findall(r"u([0-9A-Fa-f]{4})", branch))
        return "[" not in branch and "(" not in branch and bool(re.search(r"[^\x00-\x7f](?![?*{])", branch))

    return all(map(one, branches(source)))
