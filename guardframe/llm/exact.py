"""Exact dedup by DataFrame functions alone: 128-bit content hashes, compared by bytes where they are shared.

A row's hash and digest are stored without its text.  Hashes that one row has are done with; rows of the others
are read once more and grouped by hash and text, which compares bytes: texts of one hash that differ are told
apart.  Grouping combines within each task first, so of a group of copies each task sends one row.  Groups of
more than ``HOT`` rows are never dealt by their hash: they are joined by broadcast, if there are few of them.

Defined cases: null texts count as empty, and empty texts are equal to each other; null ids are rows like
others, which stay only where no equal row has an id; of rows that share both id and text one stays; an empty
table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from guardframe.llm.common import few, materialize, row_key

HOT = 1000  # rows of a group


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def chosen(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """keys, group_size, keep_id and keep_row of each group of rows (keys, id, row)."""
    by, end = (F.max_by, F.max) if keep == "largest" else (F.min_by, F.min)
    return rows.groupBy(*keys).agg(F.count("*").alias("group_size"), end("id").alias("keep_id"), F.coalesce(by("row", "id"), F.min("row")).alias("keep_row"))


def joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group; rows without one are alone."""
    hot, rest = few(groups.filter(F.col("group_size") > HOT)), few(groups.filter(F.col("group_size") <= HOT))
    both = rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(rest, keys, "left"))
    alone = F.col("group_size").isNull()
    return both.select("id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "sha", "row")


def judged(df: DataFrame, id_col: str, text_col: str, keep: str, normalize: Callable[[Column], Column] | None, content: Callable[[Column], Column], row: Column) -> DataFrame:
    """id, keep_id, group_size, kept, sha and row (a unique number) of every row."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"unknown choice {keep!r}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = df.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), (normalize(text) if normalize else text).alias("text"))
    hashed = given.withColumn("h", content(F.col("text")))
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    rows = materialize(hashed.select("id", "row", "h", sha), "digests")
    shared = materialize(chosen(rows, ["h"], keep).filter("group_size > 1"), "shared")
    met = hashed.join(few(shared.select("h")), "h", "left_semi")
    differ = materialize(met.groupBy("h", "text").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"), "differ")
    if not differ.take(1):
        return joined(rows, shared, ["h"])
    odd = few(differ)
    alike = joined(rows.join(odd, "h", "left_anti"), shared.join(odd, "h", "left_anti"), ["h"])
    apart = materialize(hashed.join(odd, "h", "left_semi").select("id", "row", "text", sha), "apart")
    return alike.unionByName(joined(apart, chosen(apart, ["text"], keep), ["text"]))


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalize: Callable[[Column], Column] | None = None, content: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when ``normalize`` makes the same bytes of them; of equal ones the row with the ``smallest``
    or ``largest`` id stays.  ``content`` is the hash that rows meet by.
    """
    out = judged(df, id_col, text_col, keep, normalize, content, F.monotonically_increasing_id())
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all of their columns."""
    keyed, key = row_key(df, id_col)
    out = judged(keyed, id_col, text_col, keep, None, content_hash, F.col(f"`{key}`"))
    gone = materialize(out.filter("NOT kept").select(F.col("row").alias(key)), "gone")
    return keyed.join(few(gone), key, "left_anti").select(df.columns)
