"""The queries of the corpus operators and their reference SQL."""

from __future__ import annotations

import corpus_pipeline
from guardframe.llm import queries as q

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_formatting": q.op1_chat_formatting,
    "op2_warc": q.op2_warc,
    "op3_ngram_jaccard_join": q.op3_ngram_jaccard_join,
    "op4_quality_rules": q.op4_quality_rules,
    "op5_toxicity": q.op5_toxicity,
    "op6_suffix_array_dedup": q.op6_suffix_array_dedup,
    "op7_sentencepiece": q.op7_sentencepiece,
    "op8_benchmark_decontamination": q.op8_benchmark_decontamination,
    "op9_token_id_output": q.op9_token_id_output,
    "op10_secret_scans": q.op10_secret_scans,
    "op11_ranked_lexical_search": q.op11_ranked_lexical_search,
    "op12_merkle_manifest": q.op12_merkle_manifest,
    "op13_exact_dedup": q.op13_exact_dedup,
}
_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLES = {
    "op11_ranked_lexical_search": f"""WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n), m AS (SELECT doc_id, 25 + (75 * n * docs) // length AS m FROM n, total),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
asked AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0) WHERE rank <= 10""",
    "op13_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
