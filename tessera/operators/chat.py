"""H1-H9: chat normalisation, templating, history prompts and session rules.

Turn tables are ``(conv_id, turn, role, text)``.  Session state of the
interactive loop (segments after ``clear``/``switch``, locked sampling mode,
active stage, end at ``quit``) is expressed with running windows per
conversation; the streaming form lives in ``streaming.chat_state``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Default system prompt of the chat loop.
DEFAULT_SYSTEM_PROMPT = "You are a helpful assistant. Respond concisely and accurately."

# ChatML template pieces (the tokenizer's template in the reference).
CHATML = {"start": "<|im_start|>", "end": "<|im_end|>\n", "generation": "<|im_start|>assistant\n"}

# Sampling presets (label, description, temperature, top_p,
# top_k, repetition_penalty, max_new_tokens).
PRESETS = [
    ("precise", "Factual / code / math — greedy-ish, low randomness", 0.1, 0.85, 40, 1.05, 1024),
    ("balanced", "General Q&A / conversation — moderate creativity", 0.5, 0.9, 50, 1.05, 512),
    ("creative", "Stories / brainstorm / open-ended — high diversity", 0.9, 0.95, 0, 1.15, 1024),
]
PRESET_SCHEMA = ("label string, description string, temperature double, top_p double, top_k int, "
                 "repetition_penalty double, max_new_tokens int")

# Prompt-classification rules, first match wins (priority,
# label, alternatives).  Each alternative is searched case-insensitively with
# word boundaries on both sides.
RULE_WORDS = [
    (1, "precise", [
        "code", "function", "implement", "debug", "fix", "compile", "syntax", "error", "traceback",
        "python", "java", "rust", r"c\+\+", "javascript", "typescript", "html", "css", "sql", "bash", "regex",
        "calculate", "compute", "solve", "math", "equation", "integral", "derivative", "proof",
        "translate .* to (?:english|french|german|spanish|chinese|japanese)",
        "summarize", "summary", "extract", "json", "xml", "csv", "parse", "convert", "define", "definition",
        "true or false", "yes or no", "correct or incorrect", "what is the",
        "how many", "how much", "exact", "precisely", "step by step",
        "explain (?:the|this|how)", "what does .* mean",
    ]),
    (2, "creative", [
        "write (?:a |me )?(?:story|poem|song|essay|script|dialogue|fiction|haiku|limerick)",
        "brainstorm", "ideas? for", "imagine", "creative", "invent", "make up",
        "role.?play", "pretend", "act as", "you are a",
        "what if", "hypothetical", "fantasy", "dream",
        "funny", "joke", "humor", "parody", "satirize",
    ]),
]
FALLBACK_LABEL = "balanced"
START_STAGE = 3
NUM_STAGES = 3

WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"


def rule_pattern(alternatives: list[str], java: bool = True) -> str:
    """Search pattern equal to Python's ``(?i)\\b(?:alts)\\b``.

    Python's ``\\b`` is Unicode-aware; Java's and RE2's are not, so the
    boundaries are spelled with explicit word classes (consuming one
    character, which is equivalent for a yes/no search).  An alternative that
    ends in a non-word character (``c\\+\\+``) needs a *word* character after it.
    """
    words = [a for a in alternatives if not a.endswith(r"\+")]
    symb = [a for a in alternatives if a.endswith(r"\+")]
    parts = [f"(?:^|{NONWORD})(?:{'|'.join(words)})(?:{NONWORD}|$)"]
    if symb:
        parts.append(f"(?:^|{NONWORD})(?:{'|'.join(symb)}){WORD}")
    flags = "(?id)" if java else "(?i)"
    return flags + "|".join(f"(?:{p})" for p in parts)


def normalise_chat(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """H1 + H2: detect the record format and return ``(conv_id, messages
    ARRAY<STRUCT<role, content>>)``.  Priority: messages > conversations >
    prompt+response; otherwise fail naming the columns (plan-time check)."""
    cols = set(df.columns)
    if "messages" in cols:
        return df.select(id_col, F.transform("messages", lambda m: F.struct(
            m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))).alias("messages"))
    if "conversations" in cols:
        fields = {f.name for f in df.schema["conversations"].dataType.elementType.fields}

        def get(m, name):
            return m[name] if name in fields else F.lit(None).cast("string")

        def role(m):
            r = F.coalesce(get(m, "from"), get(m, "role"))
            return F.when(r == "human", "user").when(r == "gpt", "assistant").otherwise(r)

        return df.select(id_col, F.transform("conversations", lambda m: F.struct(
            role(m).alias("role"),
            F.coalesce(get(m, "value"), get(m, "content"), F.lit("")).alias("content"))).alias("messages"))
    if {"prompt", "response"} <= cols:
        return df.select(id_col, F.array(
            F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"))).alias("messages"))
    raise ValueError(f"Unrecognized chat format. Columns: {sorted(cols)}")


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """Form 1 from a turn table: messages in turn order per conversation.
    A conversation is one training record (bounded by the context length)."""
    return (turns.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
            .select("conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                     m["text"].alias("content"))).alias("messages")))


def render_message(role: Column, content: Column, template: dict = CHATML) -> Column:
    return F.concat(F.lit(template["start"]), role, F.lit("\n"), content, F.lit(template["end"]))


def render(messages: DataFrame, template: dict = CHATML, col: str = "messages") -> DataFrame:
    """H3: messages -> one string with role markers, no generation prompt."""
    return messages.select("conv_id", F.array_join(F.transform(col, lambda m: render_message(
        m["role"], m["content"], template)), "").alias("text"))


def classify(text: Column, rules=RULE_WORDS, java: bool = True) -> Column:
    """H7: ordered rules, first match wins, else the fallback label."""
    out = None
    for _, label, alts in sorted(rules):
        cond = text.rlike(rule_pattern(alts, java))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(FALLBACK_LABEL))


def command_kind(text: Column) -> Column:
    """H6: the loop's checks in order: blank, quit/exit, clear, mode*, switch*."""
    s = F.lower(py_strip(text))
    return (F.when(s == "", "blank")
            .when(s.isin("quit", "exit"), "quit")
            .when(s == "clear", "clear")
            .when(s.startswith("mode"), "mode")
            .when(s.startswith("switch"), "switch")
            .otherwise("message"))


def _parts(text: Column) -> Column:
    """``str.split()`` of the stripped text."""
    from .scoring import PY_SPLIT

    return F.filter(F.split(py_strip(text), PY_SPLIT), lambda w: w != "")


def segment_sessions(turns: DataFrame) -> DataFrame:
    """H6: adds ``kind`` (user turns only; other roles are 'message') and
    ``segment`` (running count of clear/switch), and drops everything from the
    first quit on.  Windows are per conversation, ordered by turn."""
    kind = turn_kind(F.col("role"), F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumn("kind", kind)
    t = t.withColumn("_quit", F.max((F.col("kind") == "quit").cast("int")).over(w))
    t = t.withColumn("segment", F.sum(F.col("kind").isin("clear", "switch").cast("int")).over(w))
    return t.filter(F.col("_quit") == 0).drop("_quit")


def mode_value(kind: Column, text: Column) -> Column:
    """The preset (or ``auto``) that a ``mode`` turn sets; null if it sets none."""
    parts = _parts(text)
    arg = F.lower(F.try_element_at(parts, F.lit(2)))
    return F.when((kind == "mode") & (F.size(parts) >= 2) & arg.isin("auto", *[p[0] for p in PRESETS]), arg)


def stage_jump(kind: Column, text: Column) -> Column:
    """The stage that ``switch N`` names; null for any other turn."""
    parts = _parts(text)
    arg = F.try_element_at(parts, F.lit(2))
    return F.when((kind == "switch") & (F.size(parts) == 2) & arg.isin("1", "2", "3"), arg.cast("int"))


def turn_kind(role: Column, text: Column) -> Column:
    """H6 for a turn: only user turns can be commands."""
    return F.when(role == "user", command_kind(F.coalesce(text, F.lit("")))).otherwise(F.lit("message"))


def attach_modes(seg: DataFrame) -> DataFrame:
    """H8 state: ``locked`` = last ``mode X`` value before the turn (``auto``
    unlocks; bare ``mode`` and unknown names change nothing)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    value = mode_value(F.col("kind"), F.col("text"))
    return seg.withColumn("_mv", value).withColumn("locked", F.last("_mv", ignorenulls=True).over(w)).drop("_mv")


def attach_presets(seg: DataFrame, presets: DataFrame, java: bool = True) -> DataFrame:
    """H8: effective mode = locked preset if any, else the detected label;
    then the preset parameters (broadcast: one row per preset)."""
    m = attach_modes(seg)
    labels = [p[0] for p in PRESETS]
    eff = F.when(F.col("locked").isin(*labels), F.col("locked")).otherwise(classify(F.col("text"), java=java))
    m = m.filter((F.col("role") == "user") & (F.col("kind") == "message")).withColumn("mode", eff)
    return m.join(F.broadcast(presets.withColumnRenamed("label", "mode")), "mode", "left")


def active_stage(seg: DataFrame, start: int = START_STAGE) -> DataFrame:
    """H9: stage in force at each turn.  ``switch N`` (N in 1..3) jumps, any
    other switch cycles ``(cur mod 3) + 1``.  Closed form: last jump target and
    the number of cycling switches since it."""
    jump = stage_jump(F.col("kind"), F.col("text"))
    bare = ((F.col("kind") == "switch") & jump.isNull()).cast("int")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = seg.withColumn("_jump", jump).withColumn("_cum", F.sum(bare).over(w))
    t = t.withColumn("_lastj", F.last("_jump", ignorenulls=True).over(w)) \
        .withColumn("_cum_at_j", F.last(F.when(F.col("_jump").isNotNull(), F.col("_cum")), ignorenulls=True).over(w))
    base = F.coalesce(F.col("_lastj"), F.lit(start))
    since = F.col("_cum") - F.coalesce(F.col("_cum_at_j"), F.lit(0))
    return t.withColumn("stage", ((base - 1 + since) % NUM_STAGES + 1).cast("int")) \
        .drop("_jump", "_cum", "_lastj", "_cum_at_j")


def history_prompts(turns: DataFrame, system_default: str = DEFAULT_SYSTEM_PROMPT,
                    template: dict = CHATML) -> DataFrame:
    """H5: for every user message: system message + earlier turns of the same
    segment + this turn + the open assistant marker.

    The conversation's own system turn, if any, replaces the default.  The
    running window is per (conversation, segment).
    """
    seg = segment_sessions(turns) if "segment" not in turns.columns else turns
    sys_text = (seg.filter(F.col("role") == "system").groupBy("conv_id")
                .agg(F.min_by("text", "turn").alias("system_text")))
    msgs = seg.filter((F.col("role") != "system") & (F.col("kind") == "message"))
    w = Window.partitionBy("conv_id", "segment").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    content = F.when(F.col("role") == "user", py_strip(F.col("text"))).otherwise(F.col("text"))
    rendered = render_message(F.col("role"), content, template)
    h = msgs.withColumn("_hist", F.collect_list(rendered).over(w))
    h = h.filter(F.col("role") == "user").join(sys_text, "conv_id", "left")
    prompt = F.concat(render_message(F.lit("system"), F.coalesce("system_text", F.lit(system_default)), template),
                      F.array_join("_hist", ""), F.lit(template["generation"]))
    return h.select("conv_id", "turn", "segment", prompt.alias("prompt"))
