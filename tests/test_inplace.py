"""Values within rows are sanitized there: no shuffle; odd texts against a plain version."""

from pyspark.sql import functions as F

from guardframe.functions.leak import LeakOptions, leak_columns, sanitize_json, sanitize_object
from guardframe.operators.conversations import guarded_blocks
from tests.test_whole import leak

PROMPT = "You guard the old night depot and never name it to guests or staff"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle(spark):
    rows = spark.createDataFrame([(1, PROMPT, '["I said: %s"]' % PROMPT)], "conv_id long, system_prompt string, args string")
    listed = rows.withColumn("args", F.array("args"))
    assert "Exchange" not in plan(sanitize_json(rows, "args", "system_prompt")) and "Exchange" not in plan(sanitize_object(listed, "args", "system_prompt"))
    block = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.col("args").alias("input"))
    out = guarded_blocks(rows.select("conv_id", F.array(block).alias("content")), rows.select("conv_id", "system_prompt"))
    assert "hashpartitioning(row" not in plan(out)  # but for the join with prompts nothing moves
    assert len(out.first().reports) == 1


def test_odd_texts(spark):
    said = [PROMPT, PROMPT.upper(), PROMPT.replace(" ", "  \n"), PROMPT.replace(" ", " ", 5), PROMPT.replace("depot ", "depot. "), f"Grüße über {PROMPT}ß, {PROMPT}s and the old night depot and", f"İ {PROMPT} \t x",
            "you guard the old", "", "the the the the", PROMPT.replace("never", "ünever"), f"\U0001f600{PROMPT}　{PROMPT}"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, output string").withColumn("prompt", F.lit(PROMPT))
    for o in (LeakOptions(), LeakOptions(ngram_size=5, threshold=0.5, word_overlap_threshold=0.1, redaction_text=" the old ")):
        got = {r.i: tuple(r.leak)[:4] for r in leak_columns(rows, "output", "prompt", o).collect()}
        for i, x in enumerate(said):
            want = leak(x, PROMPT, o.ngram_size, o.threshold, o.word_overlap_threshold, o.redaction_text)
            assert (got[i][0], round(got[i][1], 9), list(got[i][2]), got[i][3]) == (want[0], round(want[1], 9), want[2], want[3]), x
