"""A second detector outside of Spark, such as a model's service, asked about detected texts only."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

VERDICT = "struct<detected:boolean,risk:string,matches:array<struct<category:string,pattern:string,confidence:double>>>"
Ask = Callable[[list[dict]], list[dict | None]]


def outside(ask: Ask, text_col: str = "text", out: str = "detection", size: int = 32, retries: int = 2, wait: float = 0.5) -> Callable[[DataFrame], Column]:
    """``DetectOptions.secondary`` that calls ``ask`` in tasks with up to ``size`` detected texts at a time.

    ``ask`` gets dicts of text, risk and matches and returns as many results: a dict of detected, risk and matches that
    replaces the first one, or None to keep it.  A call that fails is tried again ``retries`` times, each after twice the
    pause, then it fails the task, which Spark tries again: calls are made at least once for each detected row.
    """

    def tried(given: list[dict]) -> list[dict | None]:
        for left in range(retries, -1, -1):
            try:
                said = ask(given)
                break
            except Exception:
                if not left:
                    raise
                time.sleep(wait * 2 ** (retries - left))
        if len(said) != len(given):
            raise ValueError(f"{len(said)} results for {len(given)} texts")
        return said

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for asked in batches:
            made, places = [None] * len(asked), [i for i, x in enumerate(asked) if x is not None]
            for at in range(0, len(places), size):
                some = places[at : at + size]
                for i, said in zip(some, tried([json.loads(asked.iloc[i]) for i in some]), strict=True):
                    made[i] = None if said is None else json.dumps(said)
            yield pd.Series(made, dtype=object)

    answers = answers.asNondeterministic()  # never worked out twice, nor moved below a filter

    def column(rows: DataFrame) -> Column:
        found = F.col(out)
        question = F.to_json(F.struct(F.col(text_col).alias("text"), found["risk"].alias("risk"), found["matches"].alias("matches")))
        return F.from_json(answers(F.when(found["detected"], question)), VERDICT)

    return column
