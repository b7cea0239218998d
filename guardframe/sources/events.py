"""Logs of streamed events: a JSON object on each line, of several APIs in one file.

Lines are parsed as VARIANT, so no schema is inferred and shapes may differ by line; batch or streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def string_at(event: Column, path: str) -> Column:
    """The value at ``path`` where it is a string, else null: numbers and objects aren't text."""
    value = F.try_variant_get(event, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(event, path, "string"))


def parsed(lines: DataFrame, line_col: str = "value", event_col: str = "event") -> DataFrame:
    """``lines`` with the event as VARIANT and ``corrupt``: whether the line holds something that is no JSON.

    Empty lines and nulls are neither: their event is null.
    """
    line = F.col(line_col)
    rows = lines.withColumn(event_col, F.when(F.trim(line) != "", F.try_parse_json(line)))
    return rows.withColumn("corrupt", F.coalesce(F.trim(line) != "", F.lit(False)) & F.col(event_col).isNull())


def any_delta(event: Column) -> Column:
    """The text that an event of any known shape adds, or null."""
    kind = string_at(event, "$.type")
    block = F.when(kind == "content_block_delta", F.nullif(string_at(event, "$.delta.text"), F.lit("")))
    return F.coalesce(F.when(kind == "text-delta", string_at(event, "$.textDelta")), block, string_at(event, "$.choices[0].delta.content"))


def log_deltas(lines: DataFrame, line_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Two tables of ``lines``: those whose event adds text, with ``delta``, and the corrupt ones as they are."""
    rows = parsed(lines, line_col, "_gf_event")
    said = rows.withColumn("delta", any_delta(F.col("_gf_event"))).filter("delta IS NOT NULL").drop("_gf_event", "corrupt")
    return said, rows.filter("corrupt").drop("_gf_event", "corrupt")
