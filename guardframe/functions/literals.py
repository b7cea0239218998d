"""Which of many literals a text holds, from few looks at it.

``Found`` looks for pieces that many literals share, each begun by a rare letter: a plain search of bytes takes some
3 microseconds for 2500 characters, a pass of a regular expression ten to twenty times as long.  A found piece makes
its literals possible, not certain; literals without one are certainly absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from guardframe.functions.text import holds_text, holds_text_sql, text_sql

LETTERS = "etaoinshrdlcumwfgypbvkxjqz"  # commonest first; all else is rarer
RARE = LETTERS.index("m")  # and what follows
LEAST = 3  # characters of a key
PIECE = 4  # characters of a piece, at least, of literals as long


def rarity(c: str) -> int:
    return LETTERS.find(c) if c in LETTERS else len(LETTERS)


def key(literal: str) -> str:
    """The literal from its rarest character on, LEAST characters at least."""
    starts = range(max(1, len(literal) - LEAST + 1))
    return literal[max(starts, key=lambda i: (rarity(literal[i]), -i)) :]


def telling(sets: list[tuple[str, ...]], most: int = 2) -> list[tuple[str, ...]]:
    """Of sets of literals the best to look for: their keys begin with rare letters, and are long."""
    def worth(literals: tuple[str, ...]) -> tuple:
        return min(RARE, *(rarity(key(x.lower())[0]) for x in literals)), min(map(len, literals)), -len(literals)

    ranked = sorted(sets, key=worth, reverse=True)
    return [s for i, s in enumerate(ranked[:most]) if not i or worth(s)[0] == RARE]


def quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in text)


def trie(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings; of several that match, the longest."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [quoted(c) + written(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        if len(branches) == 1 and "" not in node:
            return branches[0]
        return f"(?:{'|'.join(branches)})" + ("?" if "" in node else "")

    return written(tree)


def one_of(keys: list[str]) -> str:
    first = "".join(quoted(c) for c in sorted({k[0] for k in keys}))
    return f"(?=[{first}])(?=({trie(keys)}))"


def pieces(literals: list[str] | tuple[str, ...]) -> list[str]:
    """Few texts, one of which is in each literal: those in most literals first; rare letters and length decide."""
    left, chosen = sorted(set(literals)), []

    def within(x: str) -> set[str]:
        few = min(PIECE, len(x))
        return {x[i : i + n] for n in range(few, len(x) + 1) for i in range(len(x) - n + 1)}

    while left:
        count: dict[str, int] = {}
        for x in left:
            for p in within(x):
                count[p] = count.get(p, 0) + 1
        best = max(count, key=lambda p: (count[p], rarity(p[0]), len(p), p))
        chosen.append(best)
        left = [x for x in left if best not in x]
    return chosen


def holds_any_sql(low: str, literals: list[str]) -> str:
    """False only where no literal occurs; ``low`` is in small letters, as literals are."""
    return "(" + " OR ".join(holds_text_sql(low, p) for p in pieces(literals)) + ")"


def holds_any(low: Column, literals: list[str]) -> Column:
    """``holds_any_sql`` as a Column."""
    return reduce(lambda a, b: a | b, [holds_text(low, p) for p in pieces(literals)])


class Found:
    """The pieces that occur in a text, as a struct of flags, and tests against it."""

    def __init__(self, literals: list[str], told: dict[str, tuple[str, ...]] | None = None):
        """``told``: for patterns, the set of ``literals`` by which each is ruled out."""
        self.pieces, self.told = pieces(literals), told or {}
        self.kind = f"struct<{', '.join(f'p{i}:boolean' for i in range(len(self.pieces)))}>" if self.pieces else "boolean"

    def sql(self, low: str) -> str:
        if not self.pieces:
            return "false"
        return f"named_struct({', '.join(f'{text_sql(f"p{i}")}, {holds_text_sql(low, p)}' for i, p in enumerate(self.pieces))})"

    def column(self, low: Column) -> Column:
        return F.struct(*(holds_text(low, p).alias(f"p{i}") for i, p in enumerate(self.pieces))) if self.pieces else F.lit(False)

    def maybe(self, seen: str, literals: list[str] | tuple[str, ...]) -> str:
        """SQL that is false only where none of ``literals`` occurs; ``seen`` names the column."""
        held = dict.fromkeys(next(i for i, p in enumerate(self.pieces) if p in x) for x in literals)
        return "(" + " OR ".join(f"{seen}.p{i}" for i in held) + ")"
