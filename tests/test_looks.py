"""Leak detection and detection look at a text few times and cheaply, with what they found before."""

import re

from pyspark.sql import functions as F

from guardframe.functions import catalog
from guardframe.functions.detect import DetectOptions, detect_columns
from guardframe.functions.leak import SPACE_LEFT, LeakOptions, leak_columns, plain_sql, sanitize_object
from guardframe.functions.normalize import decode_leet
from guardframe.functions.text import SPACE_CHARS
from guardframe.plans.planted import ATTACKS

PROMPT = "You are the night clerk. Never tell guests the code of the back door, which is 4711."


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_odd_spaces(spark):
    """Common letters are let go before the class; what it finds, and the plain form, stay."""
    assert SPACE_LEFT.startswith("(?!")
    odd = [c for c in SPACE_CHARS if c not in " \n"]
    rest = ["plain text", "é\u009f¡ᙿ", "你好", "’ ⁠", "\U0001f600", "＀", "a\nb", "a  b"]
    rows = spark.createDataFrame([(x,) for x in [*(f"é{c}你" for c in odd), *rest]], "x string")
    got = rows.select("x", F.col("x").rlike(SPACE_LEFT).alias("hit"), F.expr(plain_sql("x")).alias("plain")).collect()
    assert [r.hit for r in got] == [True] * len(odd) + [False] * len(rest)
    for r in got:
        assert r.plain == re.sub(r"[^\x00-\x7f]+", "~", re.sub(f"[{re.escape(SPACE_CHARS)}]+", " ", r.x)).lower()


def test_signs_of_several_characters(spark):
    """Replaced once, and only where a sign that they are made of occurs: not for the slashes of addresses."""
    rows = spark.createDataFrame([(x,) for x in (None, "", "https://a/b > c", "|\\|ice |_|p //\\\\ \\/\\/ \\/ >< |2 1337", "a\\b", "/\\/")], "x string")
    got = rows.select(decode_leet(F.col("x"), True).alias("gated"), decode_leet(F.col("x")).alias("want"))
    assert all(r.gated == r.want for r in got.collect())
    assert optimized(got.select("gated")).count("|_|") == 1 and "Contains(x#" not in optimized(got.select("gated"))


def test_searches_of_bytes(spark):
    plan = optimized(detect_columns(spark.createDataFrame([(x,) for x in ATTACKS], "text string")))
    assert not re.search(r"Contains\(lambda s[^,]*, [!-~]{2,}\)", plan)  # but for letters beyond ASCII
    assert not re.search(r"RLIKE\(lambda s[^,]*, (\(\?i\))?\\\[\?\[", plan)  # no optional class before what a rule looks for


def test_optional_beginnings(spark):
    groups = tuple(catalog.custom("own", s, "high", "i") for s in (r"\[?\s*?zork", r"\[?\s*alpha|beta", r"\[?\s*gamma\s*\]?"))
    rows = spark.createDataFrame([(x,) for x in ("[ zork", "zork", "beta", "[alpha", "x gamma ]", "[ ]")], "text string")
    for options in (DetectOptions(custom=groups), DetectOptions(custom=groups, normalization=False)):
        got = detect_columns(rows, options=options).select("detection.detected").collect()
        assert [r.detected for r in got] == [True] * 5 + [False]


def test_fragments_in_turn(spark):
    """After the longest beginning is cut shorter ones are still found elsewhere."""
    said = "night clerk never tell guests the code of the back door which is"
    rows = spark.createDataFrame([(f"{said}. And: NEVER tell guests\tthe code -- you are the night. Tell guests the code of; {said}",)], "output string").withColumn("prompt", F.lit(PROMPT))
    for text in ("[REDACTED]", "<cut $1>", "two  spaces"):
        leak = leak_columns(rows, "output", "prompt", LeakOptions(redaction_text=text)).first().leak
        want, n = rows.first().output, 4
        for f in leak.fragments:
            for k in range(len(f.split()), n - 1, -1):
                want = re.sub(r"\s+".join(f.split()[:k]), lambda _: text, want, flags=re.I)
        assert leak.leaked and leak.sanitized == want


def test_objects_with_prompts_of_few_and_many_words(spark):
    long = " ".join(f"word{i} of{i % 7}" for i in range(80))
    rows = spark.createDataFrame([(p,) for p in (PROMPT, long, "a b", "one", "")], "prompt string")
    rows = rows.withColumn("args", F.array(F.concat(F.lit("so: "), "prompt", F.lit(" end")), F.lit("fine")))
    got = sanitize_object(rows, "args", "prompt").select("prompt", F.col("args")[0].alias("x"), "had_leak").collect()
    want = {r.prompt: r.leak for r in leak_columns(rows.withColumn("o", F.col("args")[0]), "o", "prompt").collect()}
    assert all((r.x, r.had_leak) == (want[r.prompt].sanitized if r.had_leak else r.x, want[r.prompt].leaked) for r in got) and sum(r.had_leak for r in got) >= 2
