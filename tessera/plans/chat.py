"""H1-H9 on ``conversations`` (commands derived for a hash-chosen share of user turns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash32, sql_hash32
from ..operators import chat as Hc
from ..operators import pack, tokenize
from ..sources.corpus import read_table
from . import corpus as C
from .registry import register

S = 11
CHUNK_LEN = 512

# Derived command texts by (hash mod 25) of a user turn.
COMMANDS = ["clear", "switch", "switch 2", "mode precise", "mode auto", "   ", "quit", "MODE creative",
            "Models are great"]


def conversations(spark, sf):
    return read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def with_commands(spark, sf):
    c = conversations(spark, sf)
    h = hash32(S, "cmd", F.col("conv_id"), F.col("turn")) % 25
    txt = F.col("text")
    for i, cmd in enumerate(COMMANDS):
        txt = F.when((F.col("role") == "user") & (h == i), F.lit(cmd)).otherwise(txt)
    return c.withColumn("text", txt)


def _sql_lit(s):
    return "'" + s.replace("'", "''") + "'"


SQL_CMDS = f"""
cmds AS (SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN CASE {sql_hash32(S, "'cmd'", 'conv_id', 'turn')} % 25
    {" ".join(f"WHEN {i} THEN {_sql_lit(c)}" for i, c in enumerate(COMMANDS))} ELSE text END ELSE text END AS text
  FROM conversations),
k AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS st FROM cmds),
kinds AS (SELECT *, CASE WHEN role <> 'user' THEN 'message' WHEN st = '' THEN 'blank'
                         WHEN lower(st) IN ('quit', 'exit') THEN 'quit' WHEN lower(st) = 'clear' THEN 'clear'
                         WHEN starts_with(lower(st), 'mode') THEN 'mode' WHEN starts_with(lower(st), 'switch') THEN 'switch'
                         ELSE 'message' END AS kind,
                    list_filter(string_split_regex(st, '\\s+'), lambda w: w <> '') AS parts FROM k),
seg AS (SELECT * FROM (SELECT *,
          max(CASE WHEN kind = 'quit' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q,
          CAST(sum(CASE WHEN kind IN ('clear', 'switch') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment
        FROM kinds) WHERE q = 0)"""


def _chatml(role, content):
    return f"'<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>' || chr(10)"


@register("h1_normalise_forms", sql="""
WITH conv AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f1 AS (SELECT 'messages' AS form, conv_id, CAST(count(*) AS INTEGER) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
              md5(string_agg(text, chr(10) ORDER BY turn)) AS contents_md5 FROM conv GROUP BY conv_id),
f2 AS (SELECT 'conversations' AS form, conv_id, n_messages, roles, contents_md5 FROM f1),
f3 AS (SELECT 'prompt_response' AS form, conv_id * 100000 + turn AS conv_id, 2 AS n_messages, 'user,assistant' AS roles,
              md5(text || chr(10) || next_text) AS contents_md5 FROM conv WHERE role = 'user' AND next_role = 'assistant')
SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3""")
def h1_normalise_forms(spark, sf):
    """All three forms with their contents; form 3 has a record for every user turn that is answered."""
    from pyspark.sql import Window

    conv = conversations(spark, sf)
    f1 = Hc.turns_to_messages(conv)
    back = {"user": "human", "assistant": "gpt"}
    # every other conversation has its text under "content" in place of "value"
    f2 = f1.select("conv_id", F.transform("messages", lambda m: F.struct(
        F.when(m["role"] == "user", F.lit(back["user"])).when(m["role"] == "assistant", F.lit(back["assistant"]))
        .otherwise(m["role"]).alias("from"), F.when(F.col("conv_id") % 2 == 0, m["content"]).alias("value"),
        F.when(F.col("conv_id") % 2 == 1, m["content"]).alias("content"))).alias("conversations"))
    w = Window.partitionBy("conv_id").orderBy("turn")  # one conversation
    f3 = (conv.withColumn("_r", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
          .filter("role = 'user' and _r = 'assistant'")
          .select((F.col("conv_id") * 100000 + F.col("turn")).alias("conv_id"), F.col("text").alias("prompt"), "response"))
    out = None
    for name, df in (("messages", f1), ("conversations", f2), ("prompt_response", f3)):
        n = Hc.normalise_chat(df).select(F.lit(name).alias("form"), "conv_id", F.size("messages").alias("n_messages"),
                                         F.array_join(F.col("messages.role"), ",").alias("roles"),
                                         F.md5(F.array_join(F.col("messages.content"), "\n")).alias("contents_md5"))
        out = n if out is None else out.unionByName(n)
    return out


@register("h3_render_template", sql=f"""
SELECT conv_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (
  SELECT conv_id, string_agg({_chatml('role', 'text')}, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""")
def h3_render_template(spark, sf):
    r = Hc.render(Hc.normalise_chat(Hc.turns_to_messages(conversations(spark, sf))))
    return r.select("conv_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("h4_chat_chunks", sql=f"""
WITH rendered AS (SELECT conv_id, string_agg({_chatml('role', 'text')}, '' ORDER BY turn) AS text
                  FROM conversations GROUP BY conv_id),""" + C.sql_vocab("rendered") + "," + C.sql_token_rows("rendered", "conv_id") + f""",
ids2 AS (SELECT k, i, token_id FROM ids UNION ALL
         SELECT r.conv_id, coalesce(max(ids.i), 0) + 1, {tokenize.EOS_ID} FROM rendered r LEFT JOIN ids ON ids.k = r.conv_id GROUP BY r.conv_id),
lens AS (SELECT k, count(*) AS n FROM ids2 GROUP BY k),
starts AS (SELECT k, n, sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS st FROM lens),
stream AS (SELECT ids2.k, ids2.token_id, starts.st + ids2.i - 1 AS gpos FROM ids2 JOIN starts USING (k))""" + C.sql_chunks(CHUNK_LEN))
def h4_chat_chunks(spark, sf):
    r = Hc.render(Hc.normalise_chat(Hc.turns_to_messages(conversations(spark, sf))))
    tok = tokenize.encode(r, tokenize.build_vocab(r, "text"), append_eos=True)
    off = pack.token_offsets(tok, "conv_id")
    ch = pack.pack_chunks(off, CHUNK_LEN)
    return ch.select("chunk_id", F.size("input_ids").alias("n_tokens"), C.ids_md5().alias("ids_md5"))


@register("h5_history_prompts", sql="WITH " + SQL_CMDS + f""",
sys AS (SELECT conv_id, arg_min(text, turn) AS system_text FROM seg WHERE role = 'system' GROUP BY conv_id),
msgs AS (SELECT conv_id, turn, segment, role,
           {_chatml('role', "CASE WHEN role = 'user' THEN st ELSE text END")} AS r FROM seg WHERE role <> 'system' AND kind = 'message'),
u AS (SELECT m.conv_id, m.turn, m.segment,
        (SELECT string_agg(x.r, '' ORDER BY x.turn) FROM msgs x WHERE x.conv_id = m.conv_id AND x.segment = m.segment AND x.turn <= m.turn) AS hist
      FROM msgs m WHERE m.role = 'user'),
pr AS (SELECT u.conv_id, u.turn, u.segment,
         {_chatml("'system'", "coalesce(s.system_text, " + _sql_lit(Hc.DEFAULT_SYSTEM_PROMPT) + ")")} || u.hist || '<|im_start|>assistant' || chr(10) AS prompt
       FROM u LEFT JOIN sys s USING (conv_id))
SELECT conv_id, turn, segment, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_len FROM pr""")
def h5_history_prompts(spark, sf):
    h = Hc.history_prompts(Hc.segment_sessions(with_commands(spark, sf)))
    return h.select("conv_id", "turn", "segment", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").alias("prompt_len"))


@register("h6_segment_sessions", sql="WITH " + SQL_CMDS + " SELECT conv_id, turn, role, kind, segment FROM seg")
def h6_segment_sessions(spark, sf):
    return Hc.segment_sessions(with_commands(spark, sf)).select("conv_id", "turn", "role", "kind", "segment")


def _sql_classify(col: str) -> str:
    out = "CASE"
    for _, label, alts in sorted(Hc.RULE_WORDS):
        pat = Hc.rule_pattern(alts, java=False).replace("'", "''")
        out += f" WHEN regexp_matches({col}, '{pat}') THEN '{label}'"
    return out + f" ELSE '{Hc.FALLBACK_LABEL}' END"


@register("h7_classify_prompts", sql=f"""
SELECT conv_id, turn, {_sql_classify('text')} AS label FROM conversations WHERE role = 'user'""")
def h7_classify_prompts(spark, sf):
    c = conversations(spark, sf).filter(F.col("role") == "user")
    return c.select("conv_id", "turn", Hc.classify(F.col("text")).alias("label"))


_labels_sql = ", ".join(f"'{p[0]}'" for p in Hc.PRESETS)
_presets_sql = ", ".join("(" + ", ".join(_sql_lit(v) if isinstance(v, str) else repr(v) for v in p) + ")" for p in Hc.PRESETS)


@register("h8_attach_presets", sql="WITH " + SQL_CMDS + f""",
mv AS (SELECT *, CASE WHEN kind = 'mode' AND len(parts) >= 2 AND lower(parts[2]) = 'auto' THEN 'auto'
                      WHEN kind = 'mode' AND len(parts) >= 2 AND lower(parts[2]) IN ({_labels_sql}) THEN lower(parts[2]) END AS mv FROM seg),
lk AS (SELECT *, last_value(mv IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS locked FROM mv),
presets AS (SELECT * FROM (VALUES {_presets_sql}) t(label, description, temperature, top_p, top_k, repetition_penalty, max_new_tokens)),
m AS (SELECT conv_id, turn, CASE WHEN locked IN ({_labels_sql}) THEN locked ELSE {_sql_classify('text')} END AS mode
      FROM lk WHERE role = 'user' AND kind = 'message')
SELECT m.conv_id, m.turn, m.mode, CAST(p.temperature AS DOUBLE) AS temperature, CAST(p.top_p AS DOUBLE) AS top_p,
       CAST(p.top_k AS INTEGER) AS top_k, CAST(p.repetition_penalty AS DOUBLE) AS repetition_penalty,
       CAST(p.max_new_tokens AS INTEGER) AS max_new_tokens
FROM m LEFT JOIN presets p ON p.label = m.mode""")
def h8_attach_presets(spark, sf):
    presets = spark.createDataFrame(Hc.PRESETS, Hc.PRESET_SCHEMA)
    p = Hc.attach_presets(Hc.segment_sessions(with_commands(spark, sf)), presets)
    return p.select("conv_id", "turn", "mode", "temperature", "top_p", "top_k", "repetition_penalty", "max_new_tokens")


@register("h9_active_stage", sql="WITH " + SQL_CMDS + f""",
j AS (SELECT *, CASE WHEN kind = 'switch' AND len(parts) = 2 AND parts[2] IN ('1', '2', '3') THEN CAST(parts[2] AS INTEGER) END AS jump FROM seg),
c AS (SELECT *, CASE WHEN kind = 'switch' AND jump IS NULL THEN 1 ELSE 0 END AS bare FROM j),
c2 AS (SELECT *, sum(bare) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM c),
c3 AS (SELECT *, last_value(jump IGNORE NULLS) OVER w AS lastj,
                 last_value(CASE WHEN jump IS NOT NULL THEN cum END IGNORE NULLS) OVER w AS cum_at_j
       FROM c2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, CAST(((coalesce(lastj, {Hc.START_STAGE}) - 1 + cum - coalesce(cum_at_j, 0)) % {Hc.NUM_STAGES}) + 1 AS INTEGER) AS stage
FROM c3""")
def h9_active_stage(spark, sf):
    return Hc.active_stage(Hc.segment_sessions(with_commands(spark, sf))).select("conv_id", "turn", "stage")
