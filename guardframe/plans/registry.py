"""All queries of the engine, each with reference SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guardframe.functions import catalog, detect as dt, normalize as nz, text as tx
from guardframe.functions.detect import DetectOptions
from guardframe.functions.errors import injection_error, leak_error
from guardframe.functions.harden import HardenOptions, harden
from guardframe.functions.leak import LeakOptions, effective_size, fragments_at, leak_columns, sanitize_json, sanitize_object, shared_places, small_size, word_numbers
from guardframe.functions.secondary import outside
from guardframe.functions.sqlfunctions import create_functions
from guardframe.operators import conversations as cv
from guardframe.operators.messages import delta_text, parts_text
from guardframe.plans import planted as pl, sql
from guardframe.plans.planted import quote
from guardframe.plans.replay import replayed
from guardframe.sources.events import any_delta, parsed
from guardframe.sources.tables import read
from guardframe.streaming import chunks as ch
from guardframe.streaming.ordered import guarded_turns, ordered_chunks

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None, query) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# normalization steps
STEPS = {
    "norm_homoglyph": (nz.fold_homoglyphs, sql.homoglyphs), "norm_invisible": (nz.strip_invisible, sql.STEPS["strip_invisible"]), "norm_ws": (tx.collapse, sql.collapse),
    "norm_join": (nz.join_letters, sql.join_letters), "norm_lower": (F.lower, sql.STEPS["normalize_case"]), "norm_leet": (nz.decode_leet, sql.leet),
    "norm_typo": (lambda c: nz.words_replaced(c, nz.TYPOS), sql.typos), "norm_phonetic": (lambda c: nz.words_replaced(c, nz.PHONETICS), sql.phonetics),
    "norm_trim": (tx.trim, sql.trim), "norm_off": (lambda c: nz.normalize(c, False), lambda x: sql.normalize(x, enabled=False)),
}
for _name, (_step, _sql) in STEPS.items():
    register(_name, f"SELECT doc_id, {_sql('text')} AS norm FROM ({pl.planted_sql()})", lambda spark, sf, step=_step: pl.planted(spark, sf).select("doc_id", step(F.col("text")).alias("norm")))

for _name, _options, _off in (("norm_full", None, ()), ("norm_partial", {"decode_leetspeak": False, "collapse_whitespace": False}, ("decode_leetspeak", "collapse_whitespace"))):
    register(_name, f"SELECT doc_id, {sql.normalize('text', _off)} AS norm FROM ({pl.planted_sql()})", lambda spark, sf, o=_options: nz.normalized(pl.planted(spark, sf), options=o).select("doc_id", "norm"))

# gates
GATES = {"prefilter": (dt.prefilter, sql.prefilter), "token_bag": (dt.token_bag, sql.token_bag), "structure": (dt.suspicious_structure, sql.structure), "low_risk_gate": (dt.low_risk_gate, sql.gate)}
for _name, (_step, _sql) in GATES.items():
    register(_name, f"SELECT doc_id, {_sql('text')} AS value FROM ({pl.planted_sql()})", lambda spark, sf, step=_step: pl.planted(spark, sf).select("doc_id", step(F.col("text")).alias("value")))

# detection with options
XYZZY = catalog.custom("custom", "xyzzy", "high")
DETECTIONS = {
    "detect_default": (DetectOptions(), {}), "detect_low": (DetectOptions(threshold="low"), {"threshold": "low"}), "detect_high": (DetectOptions(threshold="high"), {"threshold": "high"}),
    "detect_critical": (DetectOptions(threshold="critical"), {"threshold": "critical"}),
    "detect_exclude": (DetectOptions(exclude=("instruction_override", "tool_hijacking")), {"exclude": ("instruction_override", "tool_hijacking")}),
    "detect_allow": (DetectOptions(allow=("Exact Safe Phrase", "")), {"allow": ("exact safe phrase",)}),
    "detect_custom": (DetectOptions(custom=(XYZZY, catalog.custom("encoding_attack", "opens the gate", "critical"))), {"more": (XYZZY, catalog.custom("encoding_attack", "opens the gate", "critical"))}),
    "detect_raw": (DetectOptions(normalization=False), {"enabled": False}), "detect_max_len": (DetectOptions(max_input_length=30), {"limit": 30}),
    "detect_no_phonetics": (DetectOptions(normalization={"repair_phonetics": False}), {"off": ("repair_phonetics",)}),
}
for _name, (_options, _args) in DETECTIONS.items():
    register(_name, sql.detect(pl.planted_sql(), **_args), lambda spark, sf, o=_options: dt.detect_columns(pl.planted(spark, sf), "text", o).select("doc_id", *dt.flat(F.col("detection"))))
register("detect_tail", sql.detect(pl.planted_sql(True)), lambda spark, sf: dt.detect_columns(pl.planted(spark, sf, True)).select("doc_id", *dt.flat(F.col("detection"))))


def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts each category's first rule hits, over matches of the low threshold."""
    found = dt.detect_columns(pl.planted(spark, sf), "text", DetectOptions(threshold="low"))
    each = found.select(F.explode("detection.matches").alias("m")).select(F.concat("m.category", F.lit("|"), "m.pattern").alias("rule"))
    return each.groupBy("rule").agg(F.count("*").alias("hits"))


register("rule_hits", f"SELECT rule, count(*) AS hits FROM (SELECT unnest(string_split(matches, ';')) AS rule FROM ({sql.detect(pl.planted_sql(), threshold='low')}) WHERE detected) GROUP BY rule", rule_hits)


def secondary(rows: DataFrame) -> Column:
    """Example of a second look: texts of documents with an even id are let go."""
    return F.when(rows["doc_id"] % 2 == 0, dt.neutral())


register("detect_secondary", f"SELECT doc_id, detected AND doc_id % 2 <> 0 AS detected, CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE risk END AS risk FROM ({sql.detect(pl.planted_sql())})",
         lambda spark, sf: dt.detect_columns(pl.planted(spark, sf), "text", DetectOptions(secondary=secondary)).select("doc_id", "detection.detected", "detection.risk"))


def nfkc_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Attacks in full-width letters; SQL has no NFKC."""
    plain, wide = "".join(map(chr, range(33, 127))), "".join(map(chr, range(0xFF01, 0xFF5F)))
    rows = pl.planted(spark, sf).withColumn("text", F.translate("text", plain, wide))
    return dt.detect_columns(rows).select("doc_id", *dt.flat(F.col("detection")))


register("nfkc_detect", sql.detect(pl.planted_sql()), nfkc_detect)  # what is folded is the planted text itself
#: Characters and what NFKC makes of them.
FOLDED = [("ﬁ", "fi"), ("①", "1"), ("Ａ", "A"), ("…", "..."), ("\u00a0", " "), ("ｶﾞ", "ガ"), ("e\u0301", "é"), ("\u212b", "Å"), ("²", "2"), ("㎏", "kg"), ("ſ", "s"), ("ñ", "ñ")]


def norm_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    """NFKC of whole documents, before which stands a character that it changes."""
    first = F.element_at(F.array(*(F.lit(a) for a, _ in FOLDED)), (F.col("doc_id") % len(FOLDED) + 1).cast("int"))
    return pl.documents(spark, sf).select("doc_id", tx.nfkc(F.concat(first, F.lit(" "), F.col("text"))).alias("norm"))


_folded = " ".join(f"WHEN {i} THEN {quote(b)}" for i, (_, b) in enumerate(FOLDED))
register("norm_nfkc", f"SELECT doc_id, (CASE doc_id % {len(FOLDED)} {_folded} END) || ' ' || text AS norm FROM documents", norm_nfkc)


# leaks
def leaks(spark: SparkSession, sf: str, options: LeakOptions | None = None) -> DataFrame:
    return leak_columns(pl.pairs(spark, sf), "output", "prompt", options)


def set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = pl.pairs(spark, sf).withColumns({"ot": tx.tokens(F.col("output")), "pt": tx.tokens(F.col("prompt"))})
    n = effective_size(F.col("pt"), 4)
    rows = rows.withColumns({"og": tx.ngrams(F.col("ot"), n), "pg": tx.ngrams(F.col("pt"), n)})
    ratio = F.when(F.size("pg") > 0, F.size(F.array_intersect("og", "pg")) / F.size("pg")).otherwise(F.lit(0.0))
    return rows.select("doc_id", F.size("ot").alias("n_tokens"), F.size("og").alias("n_ngrams"), F.round(tx.jaccard(F.col("ot"), F.col("pt")), 9).alias("word_overlap"), F.round(ratio, 9).alias("ngram_overlap"))


_leak = sql.leak(pl.PAIRS_SQL, "doc_id, output")
_set_sizes_sql = sql.leak(pl.PAIRS_SQL, "doc_id, output, len(ot) AS n_tokens, len(og) AS n_ngrams")
register("set_overlaps", _set_sizes_sql + "SELECT doc_id, n_tokens, n_ngrams, round(overlap, 9) AS word_overlap, round(ratio, 9) AS ngram_overlap FROM leaks", set_sizes)
register("tokens", f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS words FROM documents", lambda spark, sf: pl.documents(spark, sf).select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("words")))


def all_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = pl.pairs(spark, sf).withColumns({"ot": tx.tokens(F.col("output")), "pt": tx.tokens(F.col("prompt"))})
    rows = rows.withColumn("n", effective_size(F.col("pt"), 4)).withColumn("s", small_size(F.col("n")))
    rows = rows.withColumns({"both": F.array_intersect("pt", "ot"), "pg": tx.ngrams(F.col("pt"), F.col("n")), "sg": F.when((F.col("s") >= 2) & (F.size("pt") >= F.col("s")), tx.ngrams(F.col("pt"), F.col("s"))).otherwise(F.array().cast("array<string>"))})
    rows = rows.withColumn("ids", word_numbers("ot", "both"))
    rows = rows.withColumns({"at": shared_places("ot", "ids", "pg", "n"), "sat": shared_places("ot", "ids", "sg", "s")})
    return rows.select("doc_id", F.array_join(fragments_at("ot", "at", "n"), "|").alias("fragments"), F.array_join(fragments_at("ot", "sat", "s"), "|").alias("small_fragments"))


register("fragments", _leak + "SELECT doc_id, array_to_string(f, '|') AS fragments, array_to_string(sf, '|') AS small_fragments FROM leaks", all_fragments)
register("leak_decision", _leak + "SELECT doc_id, leaked, round(confidence, 9) AS confidence, array_to_string(found, '|') AS fragments FROM leaks",
         lambda spark, sf: leaks(spark, sf).select("doc_id", "leak.leaked", F.round("leak.confidence", 9).alias("confidence"), F.array_join("leak.fragments", "|").alias("fragments")))
register("redact", _leak + "SELECT doc_id, sanitized FROM leaks", lambda spark, sf: leaks(spark, sf).select("doc_id", "leak.sanitized"))
CUSTOM = LeakOptions(ngram_size=5, threshold=0.5, word_overlap_threshold=0.1, redaction_text="<cut $1>")
register("redact_custom", sql.leak(pl.PAIRS_SQL, "doc_id, output", 5, 0.5, 0.1, "<cut $1>") + "SELECT doc_id, leaked, sanitized FROM leaks", lambda spark, sf: leaks(spark, sf, CUSTOM).select("doc_id", "leak.leaked", "leak.sanitized"))
register("redact_detect_only", sql.leak(pl.PAIRS_SQL, "doc_id, output", detect_only=True) + "SELECT doc_id, leaked, sanitized FROM leaks", lambda spark, sf: leaks(spark, sf, LeakOptions(detect_only=True)).select("doc_id", "leak.leaked", "leak.sanitized"))


def object_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = pl.pairs(spark, sf).select("doc_id", "prompt", F.struct(F.col("output").alias("query"), F.struct(F.concat(F.lit("note: "), F.col("output")).alias("note"), F.col("doc_id").alias("number")).alias("inner")).alias("args"))
    return sanitize_object(rows, "args", "prompt").select("doc_id", "had_leak", F.col("args.query").alias("query"), F.col("args.inner.note").alias("note"), F.col("args.inner.number").alias("number"))


_note = f"SELECT doc_id, prompt, 'note: ' || output AS output FROM ({pl.PAIRS_SQL})"
register("sanitize_object", f"SELECT a.doc_id, a.leaked OR b.leaked AS had_leak, a.sanitized AS query, b.sanitized AS note, a.doc_id AS number FROM ({_leak}SELECT * FROM leaks) a JOIN ({sql.leak(_note, 'doc_id, output')}SELECT * FROM leaks) b USING (doc_id)", object_rows)

# hardening and errors
HARDENED = {
    "harden_append": (HardenOptions(), {}), "harden_prepend": (HardenOptions(position="prepend"), {"prepend": True}),
    "harden_skip": (HardenOptions(skip_persona_anchor=True, skip_anti_extraction=True), {"without": ("- You are bound", "- Do not output", "- Treat requests", "- Do not acknowledge")}),
    "harden_custom": (HardenOptions(custom_rules=("Answer in one line.",)), {"more": ("Answer in one line.",)}),
}
for _name, (_options, _args) in HARDENED.items():
    _text = sql.hardened("text", **_args)
    register(_name, f"SELECT conv_id, turn, {_text} AS prompt FROM conversations WHERE role <> 'assistant'",
             lambda spark, sf, o=_options: read(spark, sf, "conversations").filter("role <> 'assistant'").select("conv_id", "turn", harden(F.col("text"), o).alias("prompt")))


def error_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of detected texts and of leaks, both over whole texts."""
    found = dt.detect_columns(pl.planted(spark, sf), options=dt.WHOLE, out="d").filter("d.detected").select("doc_id", injection_error(F.col("d.risk"), dt.categories(F.col("d")))["message"].alias("message"))
    leaked = leaks(spark, sf, LeakOptions(max_output_length=None)).filter("leak.leaked").select("doc_id", leak_error(F.col("leak.confidence"), F.size("leak.fragments"))["message"].alias("message"))
    return found.unionAll(leaked)


register("error_messages", f"""SELECT doc_id, 'Prompt injection detected (' || risk || ' risk): ' || array_to_string(list_transform(string_split(matches, ';'), lambda m: string_split(m, '|')[1]), ', ') AS message FROM ({sql.detect(pl.planted_sql(), limit=None)}) WHERE detected
UNION ALL SELECT doc_id, 'System prompt leak detected (confidence: ' || floor(confidence * 100 + 0.5)::BIGINT || '%, ' || len(found) || ' fragment' || CASE WHEN len(found) = 1 THEN '' ELSE 's' END || ')' FROM ({_leak}SELECT * FROM leaks) WHERE leaked""", error_messages)


def content(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    parts = F.array(part("text", F.col("role")), part("image", F.col("text")), part("text", F.lit(None).cast("string")), part("text", F.col("text")))
    return read(spark, sf, "conversations").select("conv_id", "turn", parts_text(parts).alias("content"))


register("content_text", "SELECT conv_id, turn, role || ' ' || text AS content FROM conversations", content)

# conversations
_verdict = f"""hit AS (SELECT * FROM ({sql.detect(f"SELECT * FROM ({pl.chats_sql()}) WHERE role = 'user' AND text <> ''", "conv_id", extra=", turn")}) WHERE detected)"""
_cats = "array_to_string(list_transform(string_split(matches, ';'), lambda m: string_split(m, '|')[1]), '{}')"
register("derive_prompt", "SELECT conv_id, arg_min(text, turn) AS system_prompt FROM conversations WHERE role = 'system' GROUP BY conv_id HAVING arg_min(text, turn) <> ''", lambda spark, sf: cv.prompts(read(spark, sf, "conversations")))
register("blocked_convs", f"WITH {_verdict} SELECT conv_id, true AS blocked, 'Prompt injection detected (' || arg_min(risk, turn) || ' risk): ' || arg_min({_cats.format(', ')}, turn) AS error, count(*) AS detected FROM hit GROUP BY conv_id", lambda spark, sf: cv.verdicts(pl.chats(spark, sf)))
register("warn_audit", f"WITH {_verdict} SELECT conv_id, turn, risk, {_cats.format(',')} AS categories, 'warn' AS reaction FROM hit", lambda spark, sf: cv.audit(pl.chats(spark, sf), cv.GuardOptions(on_detection="warn")))
register("allowed_turns", f"WITH {_verdict}, c AS ({pl.chats_sql()}) SELECT conv_id, turn, role FROM c WHERE conv_id NOT IN (SELECT conv_id FROM hit)",
         lambda spark, sf: (lambda rows: cv.allowed(rows, cv.verdicts(rows)).select("conv_id", "turn", "role"))(pl.chats(spark, sf)))
register("hardened_turns", f"SELECT conv_id, turn, role, CASE WHEN role = 'system' AND text <> '' THEN {sql.hardened('text')} ELSE text END AS text FROM conversations",
         lambda spark, sf: cv.hardened(read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")))
_said = f"""SELECT c.conv_id, c.turn, c.text AS output, p.said AS prompt FROM ({pl.chats_sql()}) c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS said FROM conversations WHERE role = 'system' GROUP BY conv_id) p ON c.conv_id = p.conv_id
WHERE role = 'assistant' AND c.conv_id NOT IN (SELECT conv_id FROM (WITH {_verdict} SELECT conv_id FROM hit))"""
_message = "'System prompt leak detected (confidence: ' || floor(confidence * 100 + 0.5)::BIGINT || '%, ' || len(found) || ' fragment' || CASE WHEN len(found) = 1 THEN '' ELSE 's' END || ')'"
register("guarded_outputs", f"""SELECT conv_id, turn, leaked, sanitized AS output, CASE WHEN leaked THEN {_message} END AS leak_message FROM ({sql.leak(_said, "conv_id, turn, output")}SELECT * FROM leaks)
UNION ALL SELECT conv_id, turn, false, output, NULL FROM ({_said}) WHERE prompt IS NULL""", lambda spark, sf: cv.guarded_outputs(pl.chats(spark, sf)).select("conv_id", "turn", "leaked", "output", "leak_message"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Response content and two tool calls' arguments for every document's prompt."""
    rows = pl.pairs(spark, sf).withColumnRenamed("doc_id", "conv_id")
    asked = rows.select("conv_id", F.col("prompt").alias("system_prompt"))
    made = rows.select("conv_id", F.col("output").alias("content"), F.array(F.concat(F.lit('{"query": "'), F.col("output"), F.lit('"}')), F.lit("{}")).alias("tool_arguments"))
    out = cv.guarded_responses(made, asked)
    return out.select("conv_id", "content", "content_leaked", F.array_join("tool_arguments", "|").alias("arguments"), "arguments_leaked")


_args = f"""SELECT doc_id, prompt, '{{"query": "' || output || '"}}' AS output FROM ({pl.PAIRS_SQL})"""
register("guarded_responses", f"SELECT a.doc_id AS conv_id, a.sanitized AS content, a.leaked AS content_leaked, b.sanitized || '|{{}}' AS arguments, b.leaked AS arguments_leaked FROM ({_leak}SELECT * FROM leaks) a JOIN ({sql.leak(_args, 'doc_id, output')}SELECT * FROM leaks) b USING (doc_id)", responses)

# streams
register("chunk_string", "SELECT doc_id, k::INT AS piece_no, substring(text, k * 64 + 1, 64) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 63) // 64)) AS k FROM documents)",
         lambda spark, sf: ch.chunk_string(pl.documents(spark, sf)).select("doc_id", "piece_no", "piece"))
register("stream_chunked", "SELECT doc_id, k::INT AS chunk_no, substring(text, greatest(0, k * 1000 - 64) + 1, k * 1000 + 1000 - greatest(0, k * 1000 - 64)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS k FROM documents)",
         lambda spark, sf: ch.chunked(pl.documents(spark, sf), size=1000).select("doc_id", "chunk_no", "chunk"))
register("stream_buffer", "SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
         lambda spark, sf: ch.buffered(read(spark, sf, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"))))
_piece = f"SELECT doc_id, k::INT AS chunk_no, prompt, substring(output, greatest(0, k * 300 - 64) + 1, k * 300 + 300 - greatest(0, k * 300 - 64)) AS output FROM (SELECT *, unnest(range(0, (length(output) + 299) // 300)) AS k FROM ({pl.PAIRS_SQL}))"
register("stream_sanitized", sql.leak(_piece, "doc_id, chunk_no, output") + "SELECT doc_id, chunk_no, leaked, sanitized AS output FROM leaks",
         lambda spark, sf: ch.sanitized_chunks(pl.pairs(spark, sf), "prompt", "output", 300).select("doc_id", "chunk_no", "leaked", F.col("output")))


# the other APIs and modes
_blocked = "SELECT conv_id, true AS blocked, 'Prompt injection detected (' || arg_min(risk, turn * 10 + part) || ' risk): ' || arg_min({cats}, turn * 10 + part) AS error, count(*) AS detected FROM ({found}) WHERE detected GROUP BY conv_id"


def blocked_sql(source: str) -> str:
    """Verdicts over ``source`` (conv_id, turn, part, text)."""
    return _blocked.format(cats=_cats.format(", "), found=sql.detect(f"SELECT * FROM ({source}) WHERE text <> ''", "conv_id", extra=", turn, part"))


_users = f"SELECT * FROM ({pl.PARTED_SQL}) WHERE role = 'user'"
_joined = f"SELECT conv_id, turn, 0 AS part, CASE WHEN plain THEN text ELSE part1 || ' ' || part2 END AS text FROM ({_users})"
_each = f"SELECT conv_id, turn, 0 AS part, part1 AS text FROM ({_users}) WHERE NOT plain UNION ALL SELECT conv_id, turn, 2, part2 FROM ({_users}) WHERE NOT plain"
for _source in ("groq", "anthropic", "ai-sdk", "ai-sdk-auto"):
    _name = "blocked_" + _source.replace("-", "_")
    register(_name, blocked_sql(_each if _source == "ai-sdk-auto" else _joined), lambda spark, sf, o=cv.GuardOptions(source=_source): cv.verdicts(pl.parted(spark, sf), o))

_first_system = "SELECT conv_id, arg_min({text}, turn) AS system_prompt FROM ({source}) WHERE role = 'system' GROUP BY conv_id HAVING arg_min({text}, turn) <> ''"
register("prompt_anthropic", _first_system.format(text="part1 || ' ' || part2", source=pl.PARTED_SQL), lambda spark, sf: cv.prompts(pl.parted(spark, sf), cv.GuardOptions(source="anthropic")))
register("prompt_ai_sdk_auto", _first_system.format(text=sql.hardened("text"), source=pl.chats_sql()), lambda spark, sf: cv.prompts(pl.chats(spark, sf), cv.GuardOptions(source="ai-sdk-auto", prompt_source="hardened")))


def hardened_parts(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """Content after hardening: the string, and the parts' texts joined by bars."""
    out = cv.hardened(pl.parted(spark, sf), cv.GuardOptions(source=source))
    return out.select("conv_id", "turn", F.coalesce("text", F.lit("-")).alias("text"), F.coalesce(F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("-"))), "|"), F.lit("-")).alias("parts"))


_is = "CASE WHEN role = 'system' THEN {yes} WHEN plain THEN {plain} ELSE {no} END"
_bars = "part1 || '|-|' || part2"
register("hardened_anthropic", f"SELECT conv_id, turn, CASE WHEN plain THEN text ELSE '-' END AS text, CASE WHEN plain THEN '-' WHEN role = 'system' THEN {sql.hardened('part1')} || '|-|' || {sql.hardened('part2')} ELSE {_bars} END AS parts FROM ({pl.PARTED_SQL})", lambda spark, sf: hardened_parts(spark, sf, "anthropic"))
_one = sql.hardened("part1 || ' ' || part2")
register("hardened_ai_sdk", f"SELECT conv_id, turn, CASE WHEN role = 'system' THEN {_one} WHEN plain THEN text ELSE '-' END AS text, CASE WHEN plain OR role = 'system' THEN '-' ELSE {_bars} END AS parts FROM ({pl.PARTED_SQL})", lambda spark, sf: hardened_parts(spark, sf, "ai-sdk"))
register("hardened_ai_sdk_auto", f"SELECT conv_id, turn, CASE WHEN role = 'system' THEN {sql.hardened('text')} ELSE text END AS text FROM ({pl.chats_sql()})", lambda spark, sf: cv.hardened(pl.chats(spark, sf), cv.GuardOptions(source="ai-sdk-auto")).select("conv_id", "turn", "text"))

_leaks = f"({sql.leak(_said, 'conv_id, turn, output')}SELECT * FROM leaks)"
register("leak_audit", f"SELECT conv_id, turn, round(confidence, 9) AS confidence, len(found) AS fragments, sanitized, 'redact' AS reaction FROM {_leaks} WHERE leaked",
         lambda spark, sf: cv.leak_audit(pl.chats(spark, sf)).withColumn("confidence", F.round("confidence", 9)))
register("thrown_outputs", f"SELECT conv_id, turn, leaked, CASE WHEN NOT leaked THEN sanitized END AS output, CASE WHEN leaked THEN {_message} END AS leak_message FROM {_leaks} UNION ALL SELECT conv_id, turn, false, output, NULL FROM ({_said}) WHERE prompt IS NULL",
         lambda spark, sf: cv.guarded_outputs(pl.chats(spark, sf), cv.GuardOptions(throw_on_leak=True)).select("conv_id", "turn", "leaked", "output", "leak_message"))
OFF = cv.GuardOptions(harden=False, detect=False, sanitize=False)


def switched_off(spark: SparkSession, sf: str) -> DataFrame:
    """With every stage off: hardened turns, and outputs of all conversations as they are."""
    rows = pl.chats(spark, sf)
    verdicts = cv.verdicts(rows, OFF).groupBy().agg(F.count("*").alias("verdicts"))
    kept = cv.hardened(rows, OFF).select("conv_id", "turn", "role", "text").unionByName(cv.guarded_outputs(rows, OFF).select("conv_id", "turn", F.lit("output").alias("role"), F.col("output").alias("text")))
    return kept.crossJoin(F.broadcast(verdicts))  # one row


register("switched_off", f"WITH c AS ({pl.chats_sql()}) SELECT conv_id, turn, role, text, 0 AS verdicts FROM c UNION ALL SELECT conv_id, turn, 'output', text, 0 FROM c WHERE role = 'assistant'", switched_off)


def own_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs given by hand, some of which quote the prompt of the options."""
    said = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(pl.OWN_PROMPT + " "), F.col("text"))).otherwise(F.col("text"))
    rows = pl.chats(spark, sf).withColumn("text", F.when(F.col("role") == "assistant", said).otherwise(F.col("text")))
    out = cv.guarded_outputs(rows, cv.GuardOptions(source="ai-sdk", system_prompt=pl.OWN_PROMPT, on_detection="warn"))
    return out.select("conv_id", "turn", "leaked", "output")


_own = f"SELECT conv_id, turn, {quote(pl.OWN_PROMPT)} AS prompt, CASE WHEN conv_id % 2 = 0 THEN {quote(pl.OWN_PROMPT + ' ')} || text ELSE text END AS output FROM ({pl.chats_sql()}) WHERE role = 'assistant'"
register("outputs_ai_sdk", sql.leak(_own, "conv_id, turn, output") + "SELECT conv_id, turn, leaked, sanitized AS output FROM leaks", own_prompt)
_hard_said = f"""SELECT c.conv_id, c.turn, c.text AS output, p.said AS prompt FROM ({pl.chats_sql()}) c LEFT JOIN (SELECT conv_id, {sql.hardened('arg_min(text, turn)')} AS said FROM conversations WHERE role = 'system' GROUP BY conv_id) p ON c.conv_id = p.conv_id WHERE role = 'assistant'"""
register("outputs_ai_sdk_auto", f"SELECT conv_id, turn, leaked, sanitized AS output FROM ({sql.leak(_hard_said, 'conv_id, turn, output')}SELECT * FROM leaks) UNION ALL SELECT conv_id, turn, false, output FROM ({_hard_said}) WHERE prompt IS NULL",
         lambda spark, sf: cv.guarded_outputs(pl.chats(spark, sf), cv.GuardOptions(source="ai-sdk-auto", prompt_source="hardened", on_detection="warn")).select("conv_id", "turn", "leaked", "output"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of three blocks: a text, a tool's input of nested values, and another text that leaks nothing."""
    rows = pl.pairs(spark, sf).withColumnRenamed("doc_id", "conv_id")
    none = F.lit(None).cast("struct<query:string,items:array<struct<note:string,n:bigint>>>")
    args = F.struct(F.concat(F.lit("find "), F.col("output")).alias("query"), F.array(F.struct(F.lit("fine").alias("note"), F.col("conv_id").alias("n"))).alias("items"))
    block = lambda kind, text, given: F.struct(F.lit(kind).alias("type"), text.alias("text"), given.alias("input"))
    made = rows.select("conv_id", F.array(block("text", F.col("output"), none), block("tool_use", F.lit(None).cast("string"), args), block("text", F.lit("fine"), none)).alias("content"))
    out = cv.guarded_blocks(made, rows.select("conv_id", F.col("prompt").alias("system_prompt")))
    c = F.col("content")
    told = F.array_join(F.transform("reports", lambda r: r["message"]), "|")
    return out.select("conv_id", F.size("content").alias("blocks"), c[0]["text"].alias("text"), c[1]["input"]["query"].alias("query"), c[1]["input"]["items"][0]["note"].alias("note"), c[1]["input"]["items"][0]["n"].alias("n"), c[2]["text"].alias("last"), told.alias("reports"))


_found = f"SELECT doc_id, prompt, 'find ' || output AS output FROM ({pl.PAIRS_SQL})"
register("guarded_blocks", f"""SELECT a.doc_id AS conv_id, 3 AS blocks, a.sanitized AS text, b.sanitized AS query, 'fine' AS note, a.doc_id AS n, 'fine' AS last, concat_ws('|', CASE WHEN a.leaked THEN a.message END, CASE WHEN b.leaked THEN 'System prompt leak detected (confidence: 100%, 0 fragments)' END) AS reports
FROM ({_leak}SELECT *, {_message} AS message FROM leaks) a JOIN ({sql.leak(_found, 'doc_id, output')}SELECT * FROM leaks) b USING (doc_id)""", blocks)


def events(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """Streamed events in the shape of an API, one for each turn: those of assistants hold text."""
    rows, said = read(spark, sf, "conversations"), F.when(F.col("role") == "assistant", F.col("text"))
    shapes = {
        "openai": F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("delta"))).alias("choices")),
        "anthropic": F.struct(F.when(F.col("turn") % 2 == 0, "content_block_delta").otherwise("ping").alias("type"), F.struct(F.coalesce(said, F.lit("")).alias("text")).alias("delta")),
        "ai-sdk": F.struct(F.when(F.col("turn") % 2 == 0, "text-delta").otherwise("finish").alias("type"), said.alias("textDelta")),
    }
    return rows.select("conv_id", "turn", delta_text(shapes[source], source).alias("delta")).filter("delta IS NOT NULL")


for _source, _where in (("openai", ""), ("anthropic", " AND turn % 2 = 0 AND text <> ''"), ("ai-sdk", " AND turn % 2 = 0")):
    register("deltas_" + _source.replace("-", "_"), f"SELECT conv_id, turn, text AS delta FROM conversations WHERE role = 'assistant'{_where}", lambda spark, sf, k=_source: events(spark, sf, k))
_spoken = "SELECT conv_id AS stream_id, turn AS seq, text AS delta FROM conversations"


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"))


register("stream_passed", f"SELECT stream_id, seq, delta AS piece FROM ({_spoken}) WHERE delta <> ''", lambda spark, sf: ch.passed(deltas(spark, sf)))
register("stream_report", f"SELECT doc_id, count(*) AS leaks, 'System prompt leak detected (confidence: 100%, 0 fragments)' AS leak_message FROM ({sql.leak(_piece, 'doc_id, chunk_no, output')}SELECT * FROM leaks) WHERE leaked GROUP BY doc_id",
         lambda spark, sf: ch.chunk_report(ch.sanitized_chunks(pl.pairs(spark, sf), "prompt", "output", 300), "doc_id"))
# a stream of the AI SDK is buffered whatever mode is asked for, and given out in pieces
register("stream_ai_sdk", "SELECT conv_id AS stream_id, k::INT AS piece_no, substring(text, k * 64 + 1, 64) AS piece FROM (SELECT conv_id, text, unnest(range(0, (length(text) + 63) // 64)) AS k FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' AND turn % 2 = 0 GROUP BY conv_id))",
         lambda spark, sf: ch.chunk_string(ch.buffered(events(spark, sf, "ai-sdk").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), "delta"))).select("stream_id", "piece_no", "piece"))
register("error_codes", f"""SELECT conv_id, 'INJECTION_DETECTED' AS code, error AS message FROM (WITH {_verdict} SELECT conv_id, 'Prompt injection detected (' || arg_min(risk, turn) || ' risk): ' || arg_min({_cats.format(', ')}, turn) AS error FROM hit GROUP BY conv_id)
UNION ALL SELECT conv_id, 'LEAK_DETECTED', {_message} FROM {_leaks} WHERE leaked""", lambda spark, sf: codes(spark, sf))


def codes(spark: SparkSession, sf: str) -> DataFrame:
    """Code and message of the error of each blocked conversation and of each leaking output."""
    rows = pl.chats(spark, sf)
    hit = cv.screened(rows).filter("detection.detected")
    error = injection_error(F.col("detection.risk"), dt.categories(F.col("detection")))
    found = hit.groupBy("conv_id").agg(F.min_by(error, "turn").alias("error"))
    leaked = cv.leak_audit(rows).select("conv_id", leak_error(F.col("confidence"), F.col("fragments")).alias("error"))
    return found.unionByName(leaked).select("conv_id", "error.code", "error.message")


# leaks in nested values: the same work over the same whole texts
def whole_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Whole outputs in structs, arrays and maps of one object."""
    o = F.col("output")
    args = F.struct(o.alias("query"), F.array(F.struct(o.alias("note"), F.col("doc_id").alias("number"))).alias("notes"), F.create_map(F.lit("key"), F.array(o, F.lit("fine"))).alias("named"))
    rows = sanitize_object(pl.pairs(spark, sf).select("doc_id", "prompt", args.alias("args")), "args", "prompt")
    return rows.select("doc_id", "had_leak", F.col("args.query").alias("query"), F.col("args.notes")[0]["note"].alias("note"), F.array_join(F.element_at("args.named", "key"), "|").alias("named"))


register("whole_sanitize_object", _leak + "SELECT doc_id, leaked AS had_leak, sanitized AS query, sanitized AS note, sanitized || '|fine' AS named FROM leaks", whole_objects)
register("whole_redact", _leak + "SELECT doc_id, leaked, sanitized FROM leaks", lambda spark, sf: leaks(spark, sf).select("doc_id", "leak.leaked", "leak.sanitized"))


# JSON without a schema, and texts beyond the basic plane
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs within JSON objects, arrays and nested values: another shape by document."""
    o, n = F.col("output"), F.col("doc_id")
    shapes = [F.to_json(F.struct(o.alias("query"), n.alias("n"))), F.concat(F.lit('[{"deep": {"note": '), F.substring(F.to_json(F.array(o)), F.lit(2), F.length(F.to_json(F.array(o))) - 2), F.lit('}}, "fine", null]')),
              F.concat(F.lit('{ "list" : [1.50, {"\\u0061": '), F.substring(F.to_json(F.array(o)), F.lit(2), F.length(F.to_json(F.array(o))) - 2), F.lit("}] }"))]
    made = pl.pairs(spark, sf).select("doc_id", "prompt", F.when(n % 3 == 0, shapes[0]).when(n % 3 == 1, shapes[1]).otherwise(shapes[2]).alias("args"))
    out = sanitize_json(made, "args", "prompt")
    value = lambda path: F.get_json_object("args", path)
    rest = F.when(n % 3 == 0, value("$.n")).when(n % 3 == 1, value("$[1]")).otherwise(value("$.list[0]"))
    return out.select("doc_id", "had_leak", F.when(n % 3 == 0, value("$.query")).when(n % 3 == 1, value("$[0].deep.note")).otherwise(value("$.list[1].a")).alias("said"), rest.alias("rest"))


register("sanitize_json", _leak + "SELECT doc_id, leaked AS had_leak, sanitized AS said, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'fine' ELSE '1.5' END AS rest FROM leaks", json_rows)
ASTRAL = "\U0001f600"
# every 50th character of the first 3000 or so is beyond the basic plane; a character belongs to the piece of its last UTF-16 unit
_wide = f"SELECT doc_id, regexp_replace(text, '(.{{49}})', '\\1{ASTRAL}', 'g') AS text FROM documents"
_units = f"SELECT *, i + sum(CASE WHEN c = '{ASTRAL}' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS unit FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM ({_wide}))"
register("chunk_string_utf16", f"SELECT doc_id, (unit // 64)::INT AS piece_no, string_agg(c, '' ORDER BY i) AS piece FROM ({_units}) GROUP BY ALL",
         lambda spark, sf: ch.chunk_string(pl.documents(spark, sf).withColumn("text", F.regexp_replace("text", "([^\n]{49})", "$1" + ASTRAL))).select("doc_id", "piece_no", "piece"))


# the functions of SQL
def in_sql(query: str, rows, *only: str, **options):
    """The query over ``rows`` as {rows}, where the functions are made with ``options``."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        create_functions(spark, only=only, **options)
        return spark.sql(query, rows=rows(spark, sf))

    return run


register("sql_detect", f"SELECT d.*, n.norm FROM ({sql.detect(pl.planted_sql(), limit=None)}) d JOIN (SELECT doc_id, {sql.normalize('text')} AS norm FROM ({pl.planted_sql()})) n USING (doc_id)",
         in_sql("""SELECT doc_id, d.detected, d.risk, array_join(transform(d.matches, m -> m.category || '|' || m.pattern), ';') AS matches,
coalesce(array_min(transform(d.matches, m -> m.confidence)), 0D) AS least_confidence, norm FROM (SELECT doc_id, guard_detect(text) AS d, guard_normalize(text) AS norm FROM {rows})""", pl.planted, "normalize", "detect", detect=dt.WHOLE))  # fmt: skip
register("sql_leak", _leak + "SELECT doc_id, leaked, round(confidence, 9) AS confidence, sanitized FROM leaks",
         in_sql("SELECT doc_id, l.leaked, round(l.confidence, 9) AS confidence, l.sanitized FROM (SELECT doc_id, guard_leak(output, prompt) AS l FROM {rows})", pl.pairs, "leak"))
register("sql_harden", f"SELECT conv_id, turn, {sql.hardened('text')} AS prompt FROM conversations WHERE role = 'system'",
         in_sql("SELECT conv_id, turn, guard_harden(text) AS prompt FROM {rows} WHERE role = 'system'", lambda spark, sf: read(spark, sf, "conversations"), "harden"))


# a second detector outside, logs of events, and streams replayed
def ask(given: list[dict]) -> list[dict | None]:
    """Stands for a service: it takes back what holds a name, and keeps the rest."""
    return [{"detected": False, "risk": "none", "matches": []} if "DAN" in g["text"] else None for g in given]


register("detect_outside", f"""SELECT d.doc_id, d.detected AND NOT contains(p.text, 'DAN') AS detected, CASE WHEN contains(p.text, 'DAN') THEN 'none' ELSE d.risk END AS risk
FROM ({sql.detect(pl.planted_sql())}) d JOIN ({pl.planted_sql()}) p USING (doc_id)""",
         lambda spark, sf: dt.detect_columns(pl.planted(spark, sf), "text", DetectOptions(secondary=outside(ask))).select("doc_id", "detection.detected", "detection.risk"))


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines of a log, in a shape by turn; lines of user turns 4, 8, ... are broken off."""
    said, turn = F.col("text"), F.col("turn")
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("delta"))).alias("choices")))
    anthropic = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(said.alias("text")).alias("delta")))
    ai_sdk = F.to_json(F.struct(F.when(F.col("role") == "assistant", "text-delta").otherwise("finish").alias("type"), said.alias("textDelta")))
    line = F.when(turn % 3 == 0, openai).when(turn % 3 == 1, anthropic).otherwise(ai_sdk)
    broken = (F.col("role") == "user") & (turn % 4 == 0)
    lines = read(spark, sf, "conversations").withColumn("line", line)
    lines = lines.select("conv_id", "turn", F.when(broken, F.expr("substring(line, 1, length(line) - 2)")).otherwise(F.col("line")).alias("value"))
    rows = parsed(lines).withColumn("delta", any_delta(F.col("event")))
    return rows.filter("corrupt OR delta IS NOT NULL").select("conv_id", "turn", "corrupt", "delta")


_broken = "(role = 'user' AND turn % 4 = 0)"
register("event_log", f"SELECT conv_id, turn, {_broken} AS corrupt, CASE WHEN NOT {_broken} THEN text END AS delta FROM conversations WHERE {_broken} OR turn % 3 = 0 OR (turn % 3 = 1 AND text <> '') OR (turn % 3 = 2 AND role = 'assistant')", event_log)


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as deltas of one stream for each conversation, in no order; every fifth one comes twice."""
    rows = read(spark, sf, "conversations")
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = rows.join(ends, "conv_id").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"), (F.col("turn") == F.col("last")).alias("is_end"))
    twice = rows.filter("pmod(stream_id + seq, 5) = 0 AND NOT is_end")
    return rows.unionByName(twice).repartition(2, F.xxhash64("stream_id", "seq"))


register("stream_ordered", "SELECT stream_id, k::INT AS chunk_no, substring(text, greatest(0, k * 300 - 64) + 1, k * 300 + 300 - greatest(0, k * 300 - 64)) AS chunk FROM (SELECT stream_id, text, unnest(range(0, (length(text) + 299) // 300)) AS k FROM (SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id))",
         lambda spark, sf: replayed(spoken(spark, sf), lambda d: ordered_chunks(d, 300)).filter("NOT timed_out").select("stream_id", "chunk_no", "chunk"))
_heard = f"SELECT c.conv_id, c.turn, c.text AS output, p.said AS prompt FROM ({pl.chats_sql()}) c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS said FROM conversations WHERE role = 'system' GROUP BY conv_id) p ON c.conv_id = p.conv_id WHERE role = 'assistant'"
register("stream_guarded", f"""SELECT conv_id, turn, blocked, CASE WHEN blocked THEN error END AS error, leaked AND NOT blocked AS leaked, CASE WHEN blocked THEN NULL WHEN leaked THEN sanitized ELSE text END AS output FROM (
SELECT c.conv_id, c.turn, c.text, coalesce(c.turn >= v.at, false) AS blocked, v.error, coalesce(l.leaked, false) AS leaked, l.sanitized FROM ({pl.chats_sql()}) c
LEFT JOIN (WITH {_verdict} SELECT conv_id, min(turn) AS at, 'Prompt injection detected (' || arg_min(risk, turn) || ' risk): ' || arg_min({_cats.format(', ')}, turn) AS error FROM hit GROUP BY conv_id) v ON c.conv_id = v.conv_id
LEFT JOIN ({sql.leak(_heard, 'conv_id, turn, output')}SELECT * FROM leaks) l ON c.conv_id = l.conv_id AND c.turn = l.turn)""",
         lambda spark, sf: replayed(pl.chats(spark, sf), guarded_turns).select("conv_id", "turn", "blocked", "error", "leaked", "output"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
