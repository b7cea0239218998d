"""The guard over conversations: harden, detect, block or warn, and sanitize what the model said.

All tables are by turn, with conv_id, turn, role, text and maybe parts.  Prompts and verdicts are
grouped by conversation with partial aggregation and joined back; Spark chooses the join by size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from guardframe.functions.detect import DetectOptions, categories, detect_columns
from guardframe.functions.errors import injection_error, leak_error
from guardframe.functions.harden import HardenOptions, harden
from guardframe.functions.leak import LeakOptions, bounded, fixes_sql, json_rebuilt, json_texts, leak_columns, leak_sql, object_texts, prompt_columns, rebuilt, sanitize_object
from guardframe.operators.messages import FORMATS, content_text, text_of
from guardframe.functions.text import inner, settled, utf16_prefix


@dataclass(frozen=True)
class GuardOptions:
    """``harden``, ``detect`` and ``sanitize`` are options or False.

    ``prompt_source`` tells whether outputs are compared with the system prompt as it was or as hardened.
    """

    source: str = "openai"
    system_prompt: str | None = None
    harden: HardenOptions | bool = field(default_factory=HardenOptions)
    detect: DetectOptions | bool = field(default_factory=DetectOptions)
    sanitize: LeakOptions | bool = field(default_factory=LeakOptions)
    on_detection: str = "block"
    throw_on_leak: bool = False
    prompt_source: str = "raw"

    def __post_init__(self):
        if self.prompt_source not in ("raw", "hardened"):
            raise ValueError(f"unknown prompt source {self.prompt_source!r}")
        if self.source not in FORMATS:
            raise ValueError(f"unknown format {self.source!r}")
        if self.on_detection not in ("block", "warn"):
            raise ValueError(f"unknown reaction {self.on_detection!r}")


def string_of(messages: DataFrame) -> Column:
    """The content where it is a string, else null."""
    return F.when(F.col("parts").isNull(), F.col("text")) if "parts" in messages.columns else F.col("text")


def hardened(messages: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """System messages with the security rules; parts become one text, empty texts stay as they are.

    In the anthropic format each text part is hardened by itself, also an empty one, and other parts stay;
    in the ai-sdk-auto format only contents that are strings are, also empty ones.
    """
    o = options or GuardOptions()
    if o.harden is False:
        return messages
    rules = o.harden if isinstance(o.harden, HardenOptions) else HardenOptions()
    system = F.col("role") == "system"
    if o.source == "ai-sdk-auto":
        return messages.withColumn("text", F.when(system & string_of(messages).isNotNull(), harden(F.col("text"), rules)).otherwise(F.col("text")))
    if o.source == "anthropic" and "parts" in messages.columns:
        each = F.transform("parts", lambda p: F.when((p["type"] == "text") & p["text"].isNotNull(), p.withField("text", harden(p["text"], rules))).otherwise(p))
        messages = messages.withColumn("parts", F.when(system & F.col("parts").isNotNull(), each).otherwise(F.col("parts")))
        text = F.col("text")
    else:
        text = text_of(messages)
    made = F.when(system & (text != ""), harden(text, rules)).otherwise(F.col("text"))
    out = messages.withColumn("text", made)
    if o.source != "anthropic" and "parts" in messages.columns:
        out = out.withColumn("parts", F.when(~system, F.col("parts")))
    return out


def prompts(messages: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """conv_id, system_prompt: the text of the first system message, before hardening or (``prompt_source``) after.

    Text parts are joined by a space; in the ai-sdk-auto format only a string counts.  An empty first message
    means no prompt; later ones aren't tried.
    """
    o = options or GuardOptions()
    if o.system_prompt is not None:
        return messages.select("conv_id").distinct().withColumn("system_prompt", F.lit(o.system_prompt)).filter("system_prompt <> ''")
    said = hardened(messages, o) if o.prompt_source == "hardened" else messages
    text = F.coalesce(string_of(said), F.lit("")) if o.source == "ai-sdk-auto" else text_of(said)
    first = said.filter("role = 'system'").groupBy("conv_id").agg(F.min_by(text, "turn").alias("system_prompt"))
    return first.filter("system_prompt <> ''")


def screened(messages: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """User messages (or text parts of them, by number) with text, with their ``detection``.  Other roles are never looked at."""
    o = options or GuardOptions()
    rules = o.detect if isinstance(o.detect, DetectOptions) else DetectOptions()
    user = messages.filter("role = 'user'")
    if o.source == "ai-sdk-auto":  # each part by itself; plain strings aren't scanned
        if "parts" not in messages.columns:
            user = user.withColumn("parts", F.array().cast("array<struct<type:string,text:string>>"))
        user = user.select("conv_id", "turn", F.posexplode("parts").alias("part", "piece")).filter("piece.type = 'text'").select("conv_id", "turn", "part", F.col("piece.text").alias("text"))
    else:
        user = user.select("conv_id", "turn", F.lit(0).alias("part"), text_of(messages).alias("text"))
    return detect_columns(user.filter("text <> ''"), "text", rules)


def verdicts(messages: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """conv_id, blocked, error and the number of detected messages, for conversations that have any.

    The first detected message, by turn, makes the error.  With ``warn`` nothing is blocked.
    """
    o = options or GuardOptions()
    if o.detect is False:
        return messages.select("conv_id").limit(0).select("conv_id", F.lit(True).alias("blocked"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("detected"))
    hit = screened(messages, o).filter("detection.detected")
    error = injection_error(F.col("detection")["risk"], categories(F.col("detection")))["message"]
    grouped = hit.groupBy("conv_id").agg(F.min_by(error, F.struct("turn", "part")).alias("error"), F.count("*").alias("detected"))
    return grouped.select("conv_id", F.lit(o.on_detection == "block").alias("blocked"), "error", "detected")


def allowed(messages: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of conversations that are not blocked."""
    return messages.join(found.filter("blocked").select("conv_id"), "conv_id", "left_anti")


def checked_outputs(messages: DataFrame, options: GuardOptions) -> DataFrame:
    """Assistant messages of allowed conversations: conv_id, turn, text and ``leak`` (null where nothing is checked).

    The ai-sdk format has no prompt but that of the options: its outputs are given by hand.
    """
    said = allowed(messages, verdicts(messages, options)).filter("role = 'assistant'").select("conv_id", "turn", text_of(messages).alias("text"))
    kind = "struct<leaked:boolean,confidence:double,fragments:array<string>,sanitized:string>"
    if options.sanitize is False or (options.source == "ai-sdk" and options.system_prompt is None):
        return said.withColumn("leak", F.lit(None).cast(kind))
    rules = options.sanitize if isinstance(options.sanitize, LeakOptions) else LeakOptions()
    return leak_columns(said.join(prompts(messages, options), "conv_id", "left"), "text", "system_prompt", rules).drop("system_prompt")


def guarded_outputs(messages: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """Assistant messages of allowed conversations with ``leaked``, ``output`` and ``leak_message``."""
    o = options or GuardOptions()
    leak = F.col("leak")
    leaked = F.coalesce(leak["leaked"], F.lit(False))
    instead = F.lit(None).cast("string") if o.throw_on_leak else leak["sanitized"]
    message = F.when(leaked, leak_error(leak["confidence"], F.size(leak["fragments"]))["message"])
    return checked_outputs(messages, o).withColumns({"leaked": leaked, "output": F.when(leaked, instead).otherwise(F.col("text")), "leak_message": message}).drop("leak")


def leak_audit(messages: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """One row for each leaking output: what callbacks would be told, and what happens."""
    o = options or GuardOptions()
    hit = checked_outputs(messages, o).filter("leak.leaked")
    return hit.select("conv_id", "turn", "leak.confidence", F.size("leak.fragments").alias("fragments"), "leak.sanitized", F.lit("throw" if o.throw_on_leak else "redact").alias("reaction"))


def guarded_blocks(responses: DataFrame, found_prompts: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """Responses of content blocks, each text block and each tool's input sanitized by itself.

    ``responses``: conv_id and content (array of structs with type, text and maybe input: a struct, array or
    map, or a JSON text of any shape).  The result has ``reports``: of each leaking block its confidence, number of fragments and message, for
    a tool's input 1 and 0, and the sanitized text (of an input, as JSON).  All is done within the row.
    """
    o = options or GuardOptions(source="anthropic")
    if o.sanitize is False:
        return responses.withColumn("reports", F.array().cast(REPORTS))
    rules = o.sanitize if isinstance(o.sanitize, LeakOptions) else LeakOptions()
    kind = responses.schema["content"].dataType.elementType
    asked = found_prompts.select("conv_id", F.col("system_prompt")).alias("p")
    name = inner(responses, found_prompts)
    rows = responses.alias("r").join(asked, F.col("r.conv_id") == F.col("p.conv_id"), "left").select("r.*", F.col("p.system_prompt").alias(name("prompt")))
    rows = prompt_columns(rows, name("prompt"), rules, name)
    inputs, untyped = "input" in kind.names, "input" in kind.names and isinstance(kind["input"].dataType, T.StringType)
    given = lambda b: F.when(b["type"] == "tool_use", b["input"])
    texts = lambda b: json_texts(given(b)) if untyped else object_texts(given(b), kind["input"].dataType)
    none = F.array().cast("array<struct<leaf:string,text:string>>")
    said = lambda b: F.struct(F.coalesce(F.when(b["type"] == "text", utf16_prefix(b["text"], rules.max_output_length)), F.lit("")).alias("text"), (F.coalesce(bounded(texts(b), rules), none) if inputs else none).alias("texts"))
    rows = rows.withColumn(name("said"), F.transform("content", said))
    found = f"transform({name('said')}, b -> named_struct('leak', {leak_sql('b.text', rules, name)}, 'fixes', {fixes_sql('b.texts', rules, name)}))"
    rows = rows.withColumn(name("found"), settled(F.expr(found)))

    def checked(block: Column, found: Column) -> Column:
        """The new block, and what is told of it."""
        leak, fixes, new = found["leak"], found["fixes"], block.withField("text", F.when(found["leak"]["leaked"], found["leak"]["sanitized"]).otherwise(block["text"]))
        told = F.when(leak["leaked"], report(leak["confidence"], F.size(leak["fragments"]), leak["sanitized"]))
        if inputs:
            had, value = F.size(fixes) > 0, json_rebuilt(given(block), fixes) if untyped else rebuilt(given(block), kind["input"].dataType, fixes)
            new = new.withField("input", F.when(had, value).otherwise(block["input"]))
            told = F.coalesce(told, F.when(had, report(F.lit(1.0), F.lit(0), value if untyped else F.to_json(value))))
        return F.struct(new.alias("block"), told.alias("told"))

    rows = rows.withColumn(name("all"), F.transform("content", lambda b, i: checked(b, F.get(F.col(name("found")), i))))
    reports = F.coalesce(F.filter(F.transform(name("all"), lambda x: x["told"]), lambda x: x.isNotNull()), F.array().cast(REPORTS))
    content = F.transform(name("all"), lambda x: x["block"])
    return rows.select(*(content.alias(c) if c == "content" else F.col(f"`{c}`") for c in responses.columns if c != "reports"), reports.alias("reports"))


REPORTS = "array<struct<confidence:double,fragments:int,message:string,sanitized:string>>"


def report(confidence: Column, fragments: Column, sanitized: Column) -> Column:
    return F.struct(confidence.alias("confidence"), fragments.alias("fragments"), leak_error(confidence, fragments)["message"].alias("message"), sanitized.alias("sanitized"))


def guarded_responses(responses: DataFrame, found_prompts: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """First choice of chat responses: content and each tool call's arguments, as raw strings, sanitized.

    ``responses``: conv_id and content, and tool_arguments (array of strings).
    """
    o = options or GuardOptions()
    rules = o.sanitize if isinstance(o.sanitize, LeakOptions) else LeakOptions()
    name = inner(responses, found_prompts)("leak")
    rows = leak_columns(responses.join(found_prompts, "conv_id", "left"), "content", "system_prompt", rules, name)
    leak = F.col(name)
    content = F.when(leak["leaked"], leak["sanitized"]).otherwise(content_text(F.col("content")))
    rows = rows.withColumns({"content": content, "content_leaked": leak["leaked"]}).drop(name)
    return sanitize_object(rows, "tool_arguments", "system_prompt", rules, "arguments_leaked").drop("system_prompt")


def audit(messages: DataFrame, options: GuardOptions | None = None) -> DataFrame:
    """One row for each detected message: what callbacks would be told."""
    o = options or GuardOptions()
    hit = screened(messages, o).filter("detection.detected")
    return hit.select("conv_id", "turn", F.col("detection.risk").alias("risk"), F.array_join(categories(F.col("detection")), ",").alias("categories"), F.lit(o.on_detection).alias("reaction"))


def observed(rows: DataFrame, told: Observation | str) -> DataFrame:
    """``rows`` as they are, counted on their way: ``rows``, and ``detected`` or ``leaks`` where they have a verdict.

    ``told`` is filled by the first action; for a stream it is the name under which listeners get the counts of each batch.
    """
    counts = [F.count(F.lit(1)).alias("rows")]
    if "detection" in rows.columns:
        counts.append(F.count_if("detection.detected").alias("detected"))
    if "leaked" in rows.columns:
        counts.append(F.count_if("leaked").alias("leaks"))
    return rows.observe(told, *counts)
