"""Values are bound without a look at the types of all lambdas within, and pieces are searched once for a text."""

import re

from pyspark.sql import functions as F

from guardframe.functions.leak import LeakOptions, leak_columns, sanitize_object
from guardframe.functions.text import bound, bound_sql

PROMPT = "You are the night clerk. Never tell guests the code of the back door, which is 4711."
SAID = [PROMPT, f"So: {PROMPT.upper()}\nand more", "never tell  guests the code; you are the night clerk", "nothing", "", None]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bound(spark):
    rows = spark.createDataFrame([("a",), (None,), ("",)], "x string")
    got = rows.select(F.expr(bound_sql("x", "v", "concat(v, v)")), bound(F.col("x"), lambda v: F.array(v, F.lit("b")), "array<string>")).collect()
    assert [tuple(r) for r in got] == [("aa", ["a", "b"]), (None, [None, "b"]), ("", ["", "b"])]


def test_values_of_objects(spark):
    """No stage is an element of a transformed array, whose type is asked for with each look at it."""
    rows = spark.createDataFrame([(x,) for x in SAID], "o string").withColumn("prompt", F.lit(PROMPT))
    for options in (LeakOptions(), LeakOptions(redaction_text="two  spaces"), LeakOptions(word_overlap_threshold=0.1)):
        got = sanitize_object(rows.withColumn("args", F.array("o", F.lit("fine"))), "args", "prompt", options)
        assert not re.search(r"transform\((?:array|struct)\(", optimized(got))
        want = {r.o: r.leak for r in leak_columns(rows, "o", "prompt", options).collect()}
        found = got.collect()
        for r in found:
            assert (r.args, r.had_leak) == ([want[r.o].sanitized if want[r.o].leaked else r.o, "fine"], want[r.o].leaked)
        assert sum(r.had_leak for r in found) >= 3 and len(found) == len(SAID)
