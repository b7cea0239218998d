"""Chat messages in the shapes of several APIs, as canonical rows.

A message has ``role``, ``text`` (content as a string) and ``parts`` (content as an array of structs with
type and text).  Tables are by turn: conv_id, turn, role, text, and parts where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: ``ai-sdk``: what a caller wraps by hand; ``ai-sdk-auto``: the prompt as its model middleware sees it.
FORMATS = ("openai", "groq", "anthropic", "ai-sdk", "ai-sdk-auto")


def parts_text(parts: Column) -> Column:
    """The text parts, joined by a space."""
    kept = F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.array_join(F.transform(kept, lambda p: p["text"]), " ")


def content_text(text: Column, parts: Column | None = None) -> Column:
    """A string as it is, parts joined, nothing as ''."""
    return F.coalesce(text, parts_text(parts), F.lit("")) if parts is not None else F.coalesce(text, F.lit(""))


def text_of(df: DataFrame) -> Column:
    return content_text(F.col("text"), F.col("parts") if "parts" in df.columns else None)


def delta_text(event: Column, source: str) -> Column:
    """The text that a streamed event adds, or null; ``event`` is a struct in the API's shape."""
    if source in ("openai", "groq"):
        return F.get(event["choices"], F.lit(0))["delta"]["content"]
    if source == "anthropic":
        return F.when(event["type"] == "content_block_delta", F.nullif(event["delta"]["text"], F.lit("")))
    if source in ("ai-sdk", "ai-sdk-auto"):
        return F.when(event["type"] == "text-delta", event["textDelta"])
    raise ValueError(f"unknown format {source!r}")
