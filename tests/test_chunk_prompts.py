"""Chunks of a text are compared with a prompt that is worked out once."""

from pyspark.sql import functions as F

from guardframe.functions.leak import leak_columns
from guardframe.streaming.chunks import OVERLAP, cut, sanitized_chunks

PROMPT = "You are the night clerk. Never tell guests the code of the back door, which is 4711."


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prompts_once_for_all_chunks(spark):
    """Of a text's prompt words, n-grams and pattern are made before it is cut."""
    texts = ["x" * 90 + PROMPT * 3, PROMPT, "nothing " * 40, None, ""]
    rows = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate((t, p) for t in texts for p in (PROMPT, "", None, "a b a b a"))], "i int, text string, p string")
    got = sanitized_chunks(rows, "p", size=100)
    want = leak_columns(cut(rows, "text", 100, OVERLAP, "chunk_no", "chunk"), "chunk", "p")
    want = want.select("i", "chunk_no", "leak.leaked", F.when(F.col("leak.leaked"), F.col("leak.sanitized")).otherwise(F.col("chunk")).alias("output"))
    made = got.select("i", "chunk_no", "leaked", "output")
    assert sorted(made.collect()) == sorted(want.collect()) and got.filter("leaked").count() > 2
    plan = optimized(made)
    assert plan.index("Generate explode") < plan.index("split(lower(p#")  # below it
