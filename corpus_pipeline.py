"""A cleaning pipeline over ``documents``: five stages, each one of the corpus operators.

toxic documents go, one document of each group of near copies stays, benchmark passages are cut out,
secrets are blanked, and the rest becomes SentencePiece ids.  Each stage's result is stored as Parquet
in the shared folder and read again by the next.

Defined cases are those of the operators.  Rows with a null id or an id that occurs more than once are
told apart by a key of their own where a stage needs one.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.llm import decontaminate, jaccard, pieces, secrets, toxicity
from guardframe.llm.common import discard, few, free_name, map_arrow, materialize, row_key, table

SHINGLE, PERCENT = 5, 80  # near copies of the corpus: five words, similarity 0.8
BLANK = "[SECRET]"
#: SQL can express neither the learned lexicon nor the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    scored, name = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col(name) < toxicity.CUTOFF).drop(name)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that links connect."""
    keyed, key = row_key(docs, "doc_id")
    linked = jaccard.link(keyed, id_col=key, size=SHINGLE, percent=PERCENT)
    gone = materialize(linked.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)), "copies")
    return keyed.join(few(gone), key, "left_anti").select(docs.columns)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages; documents that mostly consist of them go."""
    return with_sizes(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets blanked: all of the base kinds, and live-looking ones of the others."""
    keyed, key = row_key(docs, "doc_id")
    held = free_name(keyed.columns, "_gf_spans")
    places = F.transform("spans", lambda s: F.struct(s["start"], s["end"]))
    found = materialize(secrets.scan(keyed, keep=[key]).filter(F.size("spans") > 0).select(key, places.alias(held)), "secrets")
    both = keyed.join(few(found, 500_000, F.size(held)), key, "left")  # 8 bytes for each span
    columns = docs.columns

    def blank(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column(held).to_pylist()):
            for a, b in reversed(secrets.merged((s["start"], s["end"]) for s in spans or ())):
                texts[i] = texts[i][:a] + BLANK + texts[i][b:]
        yield {c: batch.column(c) for c in columns} | {"text": texts}

    return with_sizes(map_arrow(both.select(*columns, held), blank, docs.schema))


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    encoded, name = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size(name).cast("long").alias("n_tokens"), F.col(name).alias("ids"))


def with_sizes(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the texts now are, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", stage_toxicity),
    ("ngram_jaccard_join", stage_near_copies),
    ("benchmark_decontamination", stage_decontaminate),
    ("secret_scans", stage_secrets),
    ("sentencepiece", stage_sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # the stage's result is stored
    return STAGES[-1][1](spark, docs, sf_dir)
