"""Errors: as data in a plan, and as exceptions for callers who want them raised."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


class GuardError(Exception):
    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


class InjectionDetectedError(GuardError):
    def __init__(self, risk: str, categories: list[str]):
        super().__init__(f"Prompt injection detected ({risk} risk): {', '.join(categories)}", "INJECTION_DETECTED")
        self.risk, self.categories = risk, categories


class LeakDetectedError(GuardError):
    def __init__(self, confidence: float, fragment_count: int):
        percent = int(confidence * 100 + 0.5)
        super().__init__(f"System prompt leak detected (confidence: {percent}%, {fragment_count} fragment{'' if fragment_count == 1 else 's'})", "LEAK_DETECTED")
        self.confidence, self.fragment_count = confidence, fragment_count


def injection_error(risk: Column, categories: Column) -> Column:
    message = F.concat(F.lit("Prompt injection detected ("), risk, F.lit(" risk): "), F.array_join(categories, ", "))
    return F.struct(F.lit("INJECTION_DETECTED").alias("code"), message.alias("message"))


def leak_error(confidence: Column, fragment_count: Column) -> Column:
    plural = F.when(fragment_count == 1, "").otherwise("s")
    percent = F.floor(confidence * 100 + F.lit(0.5)).cast("string")
    message = F.concat(F.lit("System prompt leak detected (confidence: "), percent, F.lit("%, "), fragment_count.cast("string"), F.lit(" fragment"), plural, F.lit(")"))
    return F.struct(F.lit("LEAK_DETECTED").alias("code"), message.alias("message"))


def raised(error: Column, value: Column) -> Column:
    """``value``, or a failing query where ``error`` is set (strict mode)."""
    return F.when(error.isNotNull(), F.raise_error(error["message"]).cast("string")).otherwise(value)
