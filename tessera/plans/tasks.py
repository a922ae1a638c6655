"""Task tables from ``documents`` (one sample per document,
words from the trained vocabulary) and scoring of a generations table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash32, sql_randint, sql_uniform, uniform
from ..operators import scoring as E
from ..operators import tasks as G
from ..operators import tokenize
from ..sources.corpus import read_table
from . import corpus as C
from .registry import register

S = G.SEED
SAMPLES_PER_TASK = 20_000


def H(seed, tag, *cols):
    return sql_hash32(seed, f"'{tag}'", *cols)


def U(seed, tag, *cols):
    return sql_uniform(seed, f"'{tag}'", *cols)


def RI(lo, hi, seed, tag, *cols):
    return sql_randint(lo, hi, seed, f"'{tag}'", *cols)

NUM_PAIRS = 50
HOPS = 2
NUM_LAYERS = 6
RUN = "ablation"


def nl(s: str) -> str:
    """SQL literal with newlines as chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def samples(spark, sf):
    """One sample per document. Ids are dealt out by themselves to a stated number of tasks, at least one a core: the file
    may be one split, and ids weigh too little for the adaptive planner to keep them apart, but a sample is thousands of draws."""
    ids = read_table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(ids.count() / SAMPLES_PER_TASK))
    return ids.repartition(tasks, "sample_id")


def words(spark, sf):
    """All eligible words of the corpus."""
    return tokenize.eligible_words(tokenize.build_vocab(C.docs(spark, sf), "text"))


SQL_BASE = "WITH RECURSIVE " + C.sql_vocab() + """,
samples AS (SELECT doc_id AS sample_id FROM documents),
words AS (SELECT DISTINCT token AS word FROM vocab WHERE regexp_full_match(token, '[a-zA-Z]{3,}')),
widx AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS w_idx, word FROM words),
nw AS (SELECT count(*) AS n FROM words)"""


def sql_kv(tag: str, vmax: int, n: int = NUM_PAIRS) -> str:
    return f""",
{tag}_slots AS (SELECT s.sample_id, row_number() OVER (PARTITION BY s.sample_id ORDER BY {H(S, tag + '-o', 's.sample_id', 't.j')}, t.j) - 1 AS slot,
                 t.j * n // {n} + {H(S, tag, 's.sample_id', 't.j')} % ((t.j + 1) * n // {n} - t.j * n // {n}) AS w_idx
               FROM samples s, nw, range({n}) t(j)),
{tag}_kv AS (SELECT s.sample_id, s.slot, w.word, {RI(0, vmax, S, tag + '-v', 's.sample_id', 's.slot')} AS v
             FROM {tag}_slots s JOIN widx w USING (w_idx))"""


def pool_word_sql(i: str) -> str:
    return f"(repeat(chr(CAST(97 + ({i}) % 26 AS INTEGER)), 2) || CASE WHEN ({i}) // 26 = 0 THEN '' ELSE CAST(({i}) // 26 AS VARCHAR) END)"


# ---- G SQL blocks (each defines <name>_out(task, sample_id, prompt, answer)) ----

SQL_G2 = sql_kv("ret", 100) + f""",
ret_out AS (
  SELECT '{G.RETRIEVAL}' AS task, k.sample_id,
    {nl("Memorize the following dictionary:\n")} || string_agg(k.word || ':' || k.v, chr(10) ORDER BY k.slot)
      || {nl(chr(10) + "The value of the key '")} || max(CASE WHEN k.slot = {H(S, 'ret-q', 'k.sample_id')} % {NUM_PAIRS} THEN k.word END) || ''' is' AS prompt,
    CAST(max(CASE WHEN k.slot = {H(S, 'ret-q', 'k.sample_id')} % {NUM_PAIRS} THEN k.v END) AS VARCHAR) AS answer
  FROM ret_kv k GROUP BY k.sample_id)"""

SQL_G3 = sql_kv("ar", 9) + f""",
ar_q AS (SELECT * FROM (SELECT sample_id, slot, word, v,
           row_number() OVER (PARTITION BY sample_id ORDER BY {H(S, 'ar-q', 'sample_id', 'slot')}, slot) AS qn FROM ar_kv) WHERE qn <= 3),
ar_out AS (
  SELECT '{G.AR}' AS task, k.sample_id,
    {nl("Given the following key-value pairs:\n")} || string_agg(k.word || ': ' || k.v, chr(10) ORDER BY k.slot)
      || {nl(chr(10) + "What is the value of ")} || (SELECT string_agg(q.word, ' + ' ORDER BY q.qn) FROM ar_q q WHERE q.sample_id = k.sample_id) || '?' AS prompt,
    CAST((SELECT sum(q.v) FROM ar_q q WHERE q.sample_id = k.sample_id) AS VARCHAR) AS answer
  FROM ar_kv k GROUP BY k.sample_id)"""

SQL_G4 = sql_kv("mh", 9) + f""",
mh_f AS (
  SELECT sample_id, CAST(1 AS BIGINT) AS j, [{{'parent': -1, 'depth': 0, 'val': CAST({H(S, 'mh-v', 'sample_id', '0')} % 10 AS INTEGER)}}] AS st FROM samples
  UNION ALL
  SELECT sample_id, j + 1, list_append(st, CASE WHEN {U(S, 'mh-a', 'sample_id', 'j')} < 0.4
      THEN {{'parent': CAST(p AS INTEGER), 'depth': CAST(st[p + 1].depth + 1 AS INTEGER), 'val': st[p + 1].val}}
      ELSE {{'parent': -1, 'depth': 0, 'val': CAST({H(S, 'mh-v', 'sample_id', 'j')} % 10 AS INTEGER)}} END)
  FROM (SELECT *, mem[1 + {H(S, 'mh-p', 'sample_id', 'j')} % len(mem)] AS p
        FROM (SELECT *, list_filter(range(j), lambda i: st[i + 1].depth = c) AS mem
              FROM (SELECT *, CAST(floor((sqrt(8 * ({H(S, 'mh-d', 'sample_id', 'j')} % ((m + 1) * (m + 2) // 2)) + 1) - 1) / 2) AS INTEGER) AS c
                    FROM (SELECT *, least(list_max(list_transform(st, lambda y: y.depth)), {HOPS - 1}) AS m FROM mh_f WHERE j < {NUM_PAIRS}))))),
mh_s AS (SELECT f.sample_id, i.i AS slot, st[i.i + 1].parent AS parent, st[i.i + 1].depth AS depth, st[i.i + 1].val AS val
         FROM mh_f f, range({NUM_PAIRS}) i(i) WHERE f.j = {NUM_PAIRS}),
mh_flat AS (SELECT sample_id FROM mh_s GROUP BY 1 HAVING max(depth) < 2),
mh_ones AS (SELECT sample_id, slot, val, row_number() OVER (PARTITION BY sample_id ORDER BY {H(S, 'mh-r', 'sample_id', 'slot')}, slot) AS n
            FROM mh_s JOIN mh_flat USING (sample_id) WHERE depth = 1),
mh_chain AS (SELECT a.sample_id, a.slot AS mid, a.val AS val, b.slot AS top FROM mh_ones a JOIN mh_ones b ON a.sample_id = b.sample_id AND a.n = 1 AND b.n = 2),
mh_state AS (SELECT s.sample_id, s.slot, CASE WHEN s.slot = c.top THEN c.mid ELSE s.parent END AS parent,
               CASE WHEN s.slot = c.top THEN 2 ELSE s.depth END AS depth, CASE WHEN s.slot = c.top THEN c.val ELSE s.val END AS val
             FROM mh_s s LEFT JOIN mh_chain c USING (sample_id)),
mh_e AS (SELECT s.sample_id, s.slot, k.word AS key, s.depth, s.val, CASE WHEN s.parent >= 0 THEN t.word END AS target_key,
           CASE WHEN s.parent < 0 THEN s.val END AS value
         FROM mh_state s JOIN mh_kv k ON k.sample_id = s.sample_id AND k.slot = s.slot
         LEFT JOIN mh_kv t ON t.sample_id = s.sample_id AND t.slot = s.parent),
mh_p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {H(S, 'mh-q', 'sample_id', 'slot')}, slot) AS qn FROM mh_e) WHERE qn <= 3),
mh_swap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {H(S, 'mh-qa', 'sample_id', 'slot')}, slot) AS an FROM mh_e
              WHERE depth > 0 AND sample_id IN (SELECT sample_id FROM mh_p GROUP BY 1 HAVING max(depth) = 0)) WHERE an = 1),
mh_q AS (SELECT p.sample_id, p.qn, CASE WHEN p.qn = 1 AND w.key IS NOT NULL THEN w.key ELSE p.key END AS key,
           CASE WHEN p.qn = 1 AND w.key IS NOT NULL THEN w.val ELSE p.val END AS val
         FROM mh_p p LEFT JOIN mh_swap w USING (sample_id)),
mh_out AS (
  SELECT '{G.AR_MULTIHOP}' AS task, e.sample_id,
    {nl("Given the following key-value pairs:\n")} || string_agg(e.key || ': ' || coalesce(e.target_key, CAST(e.val AS VARCHAR)), chr(10) ORDER BY e.slot)
      || {nl(chr(10) + "What is the value of ")} || (SELECT string_agg(q.key, ' + ' ORDER BY q.qn) FROM mh_q q WHERE q.sample_id = e.sample_id)
      || '? Only return the final value.' AS prompt,
    CAST((SELECT sum(q.val) FROM mh_q q WHERE q.sample_id = e.sample_id) AS VARCHAR) AS answer
  FROM mh_e e GROUP BY e.sample_id)"""

VT_CHAINS, VT_HOPS, VT_NOISE = 2, 2, 1.0
_h1 = VT_HOPS + 1
_nstat = VT_CHAINS * _h1
_nnoise = int(round(VT_NOISE * _nstat))
_letters = "[" + ",".join(f"'{x}'" for x in G.DISTRACTOR_LETTERS) + "]"
_nletters = "[" + ",".join(f"'{x}'" for x in G.NOISE_LETTERS) + "]"


def _ne(tag: str, *parts) -> str:
    r = RI(10000, 99998, S, tag, *parts)
    return f"(CASE WHEN {r} >= t.target THEN {r} + 1 ELSE {r} END)"


SQL_G6 = f""",
vt_t AS (SELECT sample_id, {RI(10000, 99999, S, 'vt-t', 'sample_id')} AS target FROM samples),
vt_items AS (
  SELECT t.sample_id, c.c * {_h1} + (i.i - 1) AS idx,
    'VAR ' || (CASE WHEN c.c = 0 THEN 'X' ELSE {_letters}[((c.c - 1) % {len(G.DISTRACTOR_LETTERS)}) + 1] END) || i.i || ' = ' ||
    CASE WHEN i.i = 1 THEN CAST(CASE WHEN c.c = 0 THEN t.target ELSE {_ne('vt-d', 't.sample_id', 'c.c')} END AS VARCHAR)
         ELSE (CASE WHEN c.c = 0 THEN 'X' ELSE {_letters}[((c.c - 1) % {len(G.DISTRACTOR_LETTERS)}) + 1] END) || (i.i - 1) END AS item
  FROM vt_t t, range({VT_CHAINS}) c(c), range(1, {_h1 + 1}) i(i)
  UNION ALL
  SELECT t.sample_id, {_nstat} + k.k AS idx,
    CASE WHEN {U(S, 'vt-nd', 't.sample_id', 'k.k')} < 0.5 THEN '......'
         ELSE 'VAR ' || {_nletters}[{H(S, 'vt-nl', 't.sample_id', 'k.k')} % 7 + 1] || {RI(1, 9, S, 'vt-ni', 't.sample_id', 'k.k')}
              || ' = ' || {_ne('vt-nv', 't.sample_id', 'k.k')} END AS item
  FROM vt_t t, range({_nnoise}) k(k)),
vt_out AS (
  SELECT '{G.VT}' AS task, i.sample_id,
    ' ...... ' || string_agg(i.item, ' ...... ' ORDER BY {H(S, 'vt-sh', 'i.sample_id', 'i.idx')}, i.idx) || ' ......' || chr(10)
      || 'Find all variables that are assigned the value ' || max(t.target) || '.' || chr(10) || 'Answer:' AS prompt,
    '{" ".join(f"X{i}" for i in range(1, _h1 + 1))}' AS answer
  FROM vt_items i JOIN vt_t t USING (sample_id) GROUP BY i.sample_id)"""

CW, UCW, FCW, FUCW = 10, 100, 2, 1
_V = CW + UCW + 16
SQL_G7 = f""",
cw_perm AS (SELECT * FROM (SELECT s.sample_id, i.i,
              row_number() OVER (PARTITION BY s.sample_id ORDER BY {H(S, 'cw-p', 's.sample_id', 'i.i')}, i.i) AS p
            FROM samples s, range({_V}) i(i)) WHERE p <= {CW + UCW}),
cw_bag AS (SELECT c.sample_id, c.i, r.r, c.p FROM cw_perm c, range({max(FCW, FUCW)}) r(r)
           WHERE r.r < CASE WHEN c.p <= {CW} THEN {FCW} ELSE {FUCW} END),
cw_out AS (
  SELECT '{G.CWE}' AS task, b.sample_id,
    {nl("Given the following list of words separated by spaces:\n")}
      || string_agg({pool_word_sql('b.i')}, ' ' ORDER BY {H(S, 'cw-b', 'b.sample_id', 'b.i', 'b.r')}, b.i, b.r)
      || {nl(f"\nWhat are the {CW} most common words in the above list?\nAnswer:")} AS prompt,
    (SELECT string_agg({pool_word_sql('c.i')}, ' ' ORDER BY {pool_word_sql('c.i')}) FROM cw_perm c
      WHERE c.sample_id = b.sample_id AND c.p <= {CW}) AS answer
  FROM cw_bag b GROUP BY b.sample_id)"""

FW_ALPHA, FW_V, FW_N = 2.0, 200, 400
_cdf = G.zipf_cdf(FW_ALPHA, FW_V)
SQL_G8 = f""",
fw_cdf AS (SELECT * FROM (VALUES {", ".join(f"({k + 1}, {repr(c)})" for k, c in enumerate(_cdf))}) t(k, c)),
fw_draw AS (SELECT s.sample_id, i.i, {U(S, 'fw', 's.sample_id', 'i.i')} AS u FROM samples s, range({FW_N}) i(i)),
fw_rank AS (SELECT d.sample_id, d.i, coalesce(c.k, 0) AS r0 FROM fw_draw d ASOF LEFT JOIN fw_cdf c ON d.u >= c.c),
fw_words AS (SELECT sample_id, i, {pool_word_sql('r0')} AS word FROM fw_rank),
fw_top AS (SELECT sample_id, string_agg(word, ' ' ORDER BY c DESC, word) AS answer FROM (
             SELECT * FROM (SELECT sample_id, word, count(*) AS c,
                    row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, word) AS rn
                    FROM fw_words GROUP BY sample_id, word) WHERE rn <= 3) GROUP BY sample_id),
fw_out AS (
  SELECT '{G.FWE}' AS task, w.sample_id,
    {nl("Given the following list of words separated by spaces:\n")} || string_agg(w.word, ' ' ORDER BY w.i)
      || {nl(chr(10) + "What are the 3 most frequently appeared words in the above coded text?" + chr(10) + "Answer:")} AS prompt,
    max(t.answer) AS answer
  FROM fw_words w JOIN fw_top t USING (sample_id) GROUP BY w.sample_id)"""

SQL_G9 = f""",
names AS (SELECT DISTINCT word FROM words WHERE regexp_full_match(word, '[A-Za-z]{{3,10}}')),
nidx AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS w_idx, word FROM names),
nn AS (SELECT count(*) AS n FROM names),
pb_s AS (SELECT sample_id, {RI(8, 30, S, 'pb-len', 'sample_id')} AS length FROM samples),
pb_e AS (SELECT s.sample_id, s.length, e.e AS slot,
           {H(S, 'pb-f', 's.sample_id', 'e.e')} % (SELECT n FROM nn) AS fi,
           {H(S, 'pb-l', 's.sample_id', 'e.e')} % (SELECT n FROM nn) AS li,
           CAST({RI(6, 9, S, 'pb-p0', 's.sample_id', 'e.e')} AS VARCHAR)
             || lpad(CAST({RI(0, 999999999, S, 'pb-p', 's.sample_id', 'e.e')} AS VARCHAR), 9, '0') AS phone
         FROM pb_s s, range(30) e(e) WHERE e.e < s.length),
pb_n AS (SELECT e.*, upper(substr(f.word, 1, 1)) || lower(substr(f.word, 2)) || ' ' || upper(substr(l.word, 1, 1)) || lower(substr(l.word, 2)) AS name
         FROM pb_e e JOIN nidx f ON f.w_idx = e.fi JOIN nidx l ON l.w_idx = e.li),
pb_q AS (SELECT * FROM (SELECT sample_id, slot, name, phone,
           row_number() OVER (PARTITION BY sample_id ORDER BY {H(S, 'pb-q', 'sample_id', 'slot')}, slot) AS qn FROM pb_n) WHERE qn <= 3),
pb_out AS (
  SELECT '{G.PHONE_BOOK}' AS task, n.sample_id,
    string_agg(n.name || ': ' || n.phone, chr(10) ORDER BY n.slot) || chr(10) || chr(10)
      || max(CASE WHEN q.qn = 1 THEN q.name || ': ' || q.phone END) || chr(10)
      || max(CASE WHEN q.qn = 2 THEN q.name || ': ' || q.phone END) || chr(10) || chr(10)
      || max(CASE WHEN q.qn = 3 THEN q.name END) || ':' AS prompt,
    max(CASE WHEN q.qn = 3 THEN q.phone END) AS answer
  FROM pb_n n LEFT JOIN pb_q q ON q.sample_id = n.sample_id AND q.slot = n.slot
  GROUP BY n.sample_id)"""

ALL_G = SQL_G2 + SQL_G3 + SQL_G4 + SQL_G6 + SQL_G7 + SQL_G8 + SQL_G9
TASK_OUT = ["ret_out", "ar_out", "mh_out", "vt_out", "cw_out", "fw_out", "pb_out"]


def _md5_out(sql_block: str, out: str) -> str:
    return SQL_BASE + sql_block + f"\nSELECT task, sample_id, md5(prompt) AS prompt_md5, answer FROM {out}"


def _md5(df):
    return df.select("task", "sample_id", F.md5("prompt").alias("prompt_md5"), "answer")


@register("g1_word_pool", sql=f"""
SELECT doc_id, i AS w_idx, {pool_word_sql('i')} AS word FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)""")
def g1_word_pool(spark, sf):
    """The pool word of each document's position."""
    return G.word_pool(read_table(spark, sf, "documents"), "doc_id")


@register("g2_retrieval", sql=_md5_out(SQL_G2, "ret_out"))
def g2_retrieval(spark, sf):
    return _md5(G.retrieval(samples(spark, sf), words(spark, sf), NUM_PAIRS))


@register("g3_associative_recall", sql=_md5_out(SQL_G3, "ar_out"))
def g3_associative_recall(spark, sf):
    return _md5(G.associative_recall(samples(spark, sf), words(spark, sf), NUM_PAIRS))


@register("g4_multihop_recall", sql=_md5_out(SQL_G4, "mh_out"))
def g4_multihop_recall(spark, sf):
    return _md5(G.multihop_recall(samples(spark, sf), words(spark, sf), NUM_PAIRS, HOPS))


@register("g5_resolve_aliases", sql=SQL_BASE + SQL_G4 + f""",
walk AS (
  SELECT sample_id, key AS start, target_key, value, 0 AS hops FROM mh_e
  UNION ALL
  SELECT w.sample_id, w.start, e.target_key, e.value, w.hops + 1
  FROM walk w JOIN mh_e e ON e.sample_id = w.sample_id AND e.key = w.target_key
  WHERE w.value IS NULL AND w.hops <= {HOPS})
SELECT sample_id, start AS key, CAST(value AS INTEGER) AS value, CAST(hops AS INTEGER) AS hops FROM walk WHERE value IS NOT NULL""")
def g5_resolve_aliases(spark, sf):
    r = G.resolve_aliases(G.multihop_edges(samples(spark, sf), words(spark, sf), NUM_PAIRS, HOPS), HOPS)
    return r.select("sample_id", "key", "value", F.col("hops").cast("int").alias("hops"))


@register("g6_variable_tracking", sql=_md5_out(SQL_G6, "vt_out"))
def g6_variable_tracking(spark, sf):
    return _md5(G.variable_tracking(samples(spark, sf), VT_CHAINS, VT_HOPS, VT_NOISE))


@register("g7_common_words", sql=_md5_out(SQL_G7, "cw_out"))
def g7_common_words(spark, sf):
    return _md5(G.common_words(samples(spark, sf), CW, UCW, FCW, FUCW))


@register("g8_frequent_words", sql=_md5_out(SQL_G8, "fw_out"))
def g8_frequent_words(spark, sf):
    return _md5(G.frequent_words(samples(spark, sf), FW_ALPHA, FW_V, FW_N))


@register("g9_phone_book", sql=_md5_out(SQL_G9, "pb_out"))
def g9_phone_book(spark, sf):
    names = G.name_pool(words(spark, sf))
    return _md5(G.phone_book(samples(spark, sf), names))


# ---- E: generations = task rows x (baseline + NUM_LAYERS ablated layers) ----------

def _p_correct(l):
    """Share of correct answers: 0.9 for the baseline, lower and varied per layer."""
    return F.when(l < 0, F.lit(0.9)).otherwise(F.lit(0.3) + F.lit(0.6) * ((l * 7) % NUM_LAYERS) / NUM_LAYERS)


def _text(task, ans, ok):
    """Synthetic model output: correct-shaped when ``ok``, else a wrong shape."""
    return (F.when(task == G.RETRIEVAL, F.when(ok, F.concat(F.lit("The value is "), ans, F.lit("."))).otherwise(F.lit("I am not sure.")))
            .when(task == G.AR_MULTIHOP, F.when(ok, F.concat(F.lit("It adds up to "), ans, F.lit("."))).otherwise(F.lit("I cannot resolve it")))
            .when(task == G.AR, F.when(ok, F.concat(F.lit("The answer is "), ans)).otherwise(F.lit("unknown")))
            .when(task == G.VT, F.when(ok, F.concat(F.lit("Answer: "), ans)).otherwise(F.lit("X1")))
            .when(task == G.CWE, F.when(ok, F.concat(ans, F.lit("\nExplanation: these repeat"))).otherwise(F.lit("none")))
            .when(task == G.FWE, F.when(ok, F.concat(ans, F.lit(" Explanation"))).otherwise(F.lit("none")))
            .when(task == G.PHONE_BOOK, F.when(ok, F.concat(ans, F.lit("\nDone"))).otherwise(F.concat(F.lit("\n"), ans)))
            .otherwise(F.lit("")))


def task_tables(spark, sf, which=None):
    s = samples(spark, sf)
    asked = set(which or [G.RETRIEVAL, G.AR, G.AR_MULTIHOP, G.PHONE_BOOK])
    paired, named = {G.RETRIEVAL, G.AR, G.AR_MULTIHOP} & asked, G.PHONE_BOOK in asked
    w = words(spark, sf) if paired or named else None
    index = G.index_words(w) if paired else None  # one for all
    build = {
        G.RETRIEVAL: lambda: G.retrieval(s, index, NUM_PAIRS),
        G.AR: lambda: G.associative_recall(s, index, NUM_PAIRS),
        G.AR_MULTIHOP: lambda: G.multihop_recall(s, index, NUM_PAIRS, HOPS),
        G.VT: lambda: G.variable_tracking(s, VT_CHAINS, VT_HOPS, VT_NOISE),
        G.CWE: lambda: G.common_words(s, CW, UCW, FCW, FUCW),
        G.FWE: lambda: G.frequent_words(s, FW_ALPHA, FW_V, FW_N),
        G.PHONE_BOOK: lambda: G.phone_book(s, G.name_pool(w)),
    }
    out = None
    for name in which or list(build):
        t = build[name]()
        out = t if out is None else out.unionByName(t)
    return out


def generations(spark, sf, which=None):
    t = E.with_references(task_tables(spark, sf, which)).drop("prompt")
    g = t.select("*", F.explode(F.sequence(F.lit(-1), F.lit(NUM_LAYERS - 1))).alias("l"))
    ok = uniform(S, "gen", F.col("task"), F.col("sample_id"), F.col("l")) < _p_correct(F.col("l"))
    return g.select(F.lit(RUN).alias("run"), "task", "sample_id", "answer", "allowed", "gold_words",
                    F.when(F.col("l") >= 0, F.col("l")).cast("int").alias("layer_index"),
                    _text(F.col("task"), F.col("answer"), ok).alias("text"))


def _sql_gens(tasks_out: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {o}" for o in tasks_out)
    p = f"CASE WHEN l.l < 0 THEN 0.9 ELSE 0.3 + 0.6 * ((l.l * 7) % {NUM_LAYERS}) / {NUM_LAYERS} END"
    ok = f"({U(S, 'gen', 't.task', 't.sample_id', 'l.l')} < {p})"
    text = f"""CASE t.task
      WHEN '{G.RETRIEVAL}' THEN CASE WHEN {ok} THEN 'The value is ' || t.answer || '.' ELSE 'I am not sure.' END
      WHEN '{G.AR_MULTIHOP}' THEN CASE WHEN {ok} THEN 'It adds up to ' || t.answer || '.' ELSE 'I cannot resolve it' END
      WHEN '{G.AR}' THEN CASE WHEN {ok} THEN 'The answer is ' || t.answer ELSE 'unknown' END
      WHEN '{G.VT}' THEN CASE WHEN {ok} THEN 'Answer: ' || t.answer ELSE 'X1' END
      WHEN '{G.CWE}' THEN CASE WHEN {ok} THEN t.answer || chr(10) || 'Explanation: these repeat' ELSE 'none' END
      WHEN '{G.FWE}' THEN CASE WHEN {ok} THEN t.answer || ' Explanation' ELSE 'none' END
      WHEN '{G.PHONE_BOOK}' THEN CASE WHEN {ok} THEN t.answer || chr(10) || 'Done' ELSE chr(10) || t.answer END
      ELSE '' END"""
    return f""",
tasks_all AS ({union}),
gens AS (SELECT '{RUN}' AS run, t.task, t.sample_id, t.prompt, t.answer,
           CAST(CASE WHEN l.l >= 0 THEN l.l END AS INTEGER) AS layer_index, {text} AS text
         FROM tasks_all t, range(-1, {NUM_LAYERS}) l(l)),
parsed AS (SELECT *,
  regexp_extract(text, '\\p{{Nd}}+', 0) AS first_int,
  list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, 'X\\p{{Nd}}+')))) AS vars,
  list_filter(string_split_regex(regexp_extract(prompt, '(?s)separated by spaces:\\n(.*?)\\nWhat are', 1), '\\s+'), lambda w: w <> '') AS allowed,
  list_filter(string_split_regex(answer, '\\s+'), lambda w: w <> '') AS gold_words,
  regexp_extract_all(CASE WHEN position('Explanation' IN text) > 0 THEN substr(text, 1, position('Explanation' IN text) - 1) ELSE text END,
                     '[A-Za-z0-9_]+') AS toks,
  CASE WHEN length(text) = 0 THEN NULL ELSE
    regexp_replace(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')[1], '^\\s+|\\s+$', '', 'g') END AS first_line
  FROM gens),
parsed2 AS (SELECT *, list_filter(list_filter(toks, lambda t: list_contains(allowed, t)),
                                  lambda t, i: list_position(list_filter(toks, lambda u: list_contains(allowed, u)), t) = i) AS dtoks
            FROM parsed),
scored AS (SELECT *, coalesce(CASE task
  WHEN '{G.RETRIEVAL}' THEN first_int = answer
  WHEN '{G.AR}' THEN contains(text, answer)
  WHEN '{G.AR_MULTIHOP}' THEN contains(text, answer)
  WHEN '{G.VT}' THEN vars = list_sort(list_distinct(gold_words))
  WHEN '{G.CWE}' THEN list_sort(list_distinct(dtoks[1:len(gold_words)])) = list_sort(list_distinct(gold_words))
  WHEN '{G.FWE}' THEN dtoks[1:3] = gold_words
  WHEN '{G.PHONE_BOOK}' THEN first_line = answer
  ELSE false END, false) AS correct FROM parsed2),
acc AS (SELECT run, task, layer_index, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n_samples
        FROM scored GROUP BY run, task, layer_index),
drops AS (SELECT a.run, a.task, a.layer_index, b.accuracy AS baseline_accuracy, a.accuracy,
                 b.accuracy - a.accuracy AS performance_drop
          FROM acc a JOIN acc b ON b.run = a.run AND b.task = a.task AND b.layer_index IS NULL
          WHERE a.layer_index IS NOT NULL)"""


def _e_sql(blocks: str, outs: list[str], select: str) -> str:
    return SQL_BASE + blocks + _sql_gens(outs) + "\n" + select


def _scored(spark, sf, which):
    return E.score(generations(spark, sf, which))


@register("e1_first_int", sql=_e_sql(SQL_G2, ["ret_out"],
          "SELECT sample_id, layer_index, first_int AS parsed, correct FROM scored"))
def e1_first_int(spark, sf):
    s = _scored(spark, sf, [G.RETRIEVAL])
    return s.select("sample_id", "layer_index", E.first_int(F.col("text")).alias("parsed"), "correct")


@register("e2_substring_match", sql=_e_sql(SQL_G3 + SQL_G4, ["ar_out", "mh_out"], "SELECT task, sample_id, layer_index, correct FROM scored"))
def e2_substring_match(spark, sf):
    return _scored(spark, sf, [G.AR, G.AR_MULTIHOP]).select("task", "sample_id", "layer_index", "correct")


@register("e3_variable_set", sql=_e_sql(SQL_G6, ["vt_out"],
          "SELECT sample_id, layer_index, array_to_string(vars, ' ') AS vars, correct FROM scored"))
def e3_variable_set(spark, sf):
    s = _scored(spark, sf, [G.VT])
    return s.select("sample_id", "layer_index", F.array_join(E.var_set(F.col("text")), " ").alias("vars"), "correct")


@register("e4_prompt_words", sql=SQL_BASE + SQL_G7 + """,
w AS (SELECT sample_id, list_filter(string_split_regex(regexp_extract(prompt, '(?s)separated by spaces:\\n(.*?)\\nWhat are', 1), '\\s+'), lambda x: x <> '') AS ws FROM cw_out)
SELECT sample_id, CAST(len(ws) AS INTEGER) AS n_words, md5(array_to_string(ws, ' ')) AS words_md5 FROM w""")
def e4_prompt_words(spark, sf):
    t = G.common_words(samples(spark, sf), CW, UCW, FCW, FUCW)
    ws = E.prompt_words(F.col("prompt"))
    return t.select("sample_id", F.size(ws).alias("n_words"), F.md5(F.array_join(ws, " ")).alias("words_md5"))


@register("e5_topk_parse", sql=_e_sql(SQL_G8, ["fw_out"],
          "SELECT sample_id, layer_index, array_to_string(dtoks[1:3], ' ') AS parsed FROM scored"))
def e5_topk_parse(spark, sf):
    g = generations(spark, sf, [G.FWE])
    parsed = E.top_k_tokens(F.col("text"), F.col("allowed"), 3)
    return g.select("sample_id", "layer_index", F.array_join(parsed, " ").alias("parsed"))


@register("e6_common_words_score", sql=_e_sql(SQL_G7, ["cw_out"], "SELECT sample_id, layer_index, correct FROM scored"))
def e6_common_words_score(spark, sf):
    return _scored(spark, sf, [G.CWE]).select("sample_id", "layer_index", "correct")


@register("e7_frequent_words_score", sql=_e_sql(SQL_G8, ["fw_out"], "SELECT sample_id, layer_index, correct FROM scored"))
def e7_frequent_words_score(spark, sf):
    return _scored(spark, sf, [G.FWE]).select("sample_id", "layer_index", "correct")


@register("e8_first_line", sql=_e_sql(SQL_G9, ["pb_out"],
          "SELECT sample_id, layer_index, first_line, correct FROM scored"))
def e8_first_line(spark, sf):
    s = _scored(spark, sf, [G.PHONE_BOOK])
    return s.select("sample_id", "layer_index", E.first_line(F.col("text")).alias("first_line"), "correct")


@register("e9_accuracy", sql=_e_sql(ALL_G, TASK_OUT,
          "SELECT run, task, layer_index, round(accuracy, 6) AS accuracy, n_samples FROM acc"))
def e9_accuracy(spark, sf):
    a = E.accuracy(_scored(spark, sf, None))
    return a.select("run", "task", "layer_index", F.round("accuracy", 6).alias("accuracy"), "n_samples")


@register("e10_ablation_drop", sql=_e_sql(ALL_G, TASK_OUT, """
SELECT run, task, layer_index, round(baseline_accuracy, 6) AS baseline_accuracy, round(accuracy, 6) AS accuracy,
       round(performance_drop, 6) AS performance_drop FROM drops"""))
def e10_ablation_drop(spark, sf):
    d = E.ablation_drop(E.accuracy(_scored(spark, sf, None)))
    return d.select("run", "task", "layer_index", F.round("baseline_accuracy", 6).alias("baseline_accuracy"),
                    F.round("accuracy", 6).alias("accuracy"), F.round("performance_drop", 6).alias("performance_drop"))


@register("e11_importance_rank", sql=_e_sql(ALL_G, TASK_OUT, """
SELECT run, task, layer_index, CAST(row_number() OVER (PARTITION BY run, task ORDER BY performance_drop DESC, layer_index) AS INTEGER) AS importance_rank
FROM drops"""))
def e11_importance_rank(spark, sf):
    r = E.importance_rank(E.ablation_drop(E.accuracy(_scored(spark, sf, None))))
    return r.select("run", "task", "layer_index", "importance_rank")


@register("s7_result_sinks", sql=_e_sql(ALL_G, TASK_OUT, """
SELECT task, layer_index, round(accuracy, 6) AS accuracy, round(performance_drop, 6) AS performance_drop FROM drops
UNION ALL SELECT task, NULL, round(accuracy, 6), NULL FROM acc WHERE layer_index IS NULL"""))
def s7_result_sinks(spark, sf):
    """Baseline rows -> JSON, per-layer table -> CSV with header; both read back. Scored once."""
    from ..session import scratch_path
    from ..sources import sinks

    path = scratch_path(spark, "accuracy")
    E.accuracy(_scored(spark, sf, None)).write.parquet(path)
    acc = spark.read.parquet(path)
    drops = E.ablation_drop(acc).select("task", "layer_index", "accuracy", "performance_drop")
    stem = sinks.result_name("student/model-0.5", "all_tasks", pairs=NUM_PAIRS)
    paths = sinks.write_results(acc.filter(F.col("layer_index").isNull()), drops, scratch_path(spark, "results"), stem)
    schema = "task string, layer_index int, accuracy double, performance_drop double"
    back = spark.read.option("header", True).schema(schema).csv(paths["layers"])
    back = back.unionByName(spark.read.schema(schema).json(paths["baseline"]))
    return back.select("task", "layer_index", F.round("accuracy", 6).alias("accuracy"),
                       F.round("performance_drop", 6).alias("performance_drop"))
