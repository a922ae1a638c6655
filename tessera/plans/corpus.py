"""S1-S4, T1-T6, C1-C5 on ``documents`` (and ``benchmark`` for C5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD_TOKEN_PATTERN
from ..operators import pack, tokenize
from ..session import scratch_path, written
from ..sources import corpus, sinks
from ..sources.chunk_store import ChunkStore
from ..sources.token_store import TokenStore
from .registry import register

CHUNK_LEN = 512
STAGE_LENGTHS = [512, 4096]
TRUNCATE_AT = 64
HEAD_ROWS = 50

PAT = WORD_TOKEN_PATTERN


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.read_corpus(spark, f"{sf}/documents.parquet", "text", "doc_id")


def vocab_df(spark, sf):
    return tokenize.build_vocab(docs(spark, sf), "text")


def encoded(spark, sf, **kw) -> DataFrame:
    d = docs(spark, sf)
    return tokenize.encode(d, tokenize.build_vocab(d, "text"), "text", **kw)


def ids_md5(col: str = "input_ids"):
    return F.md5(F.array_join(F.col(col), ","))


# ---- DuckDB building blocks ------------------------------------------------

def sql_vocab(table: str = "documents") -> str:
    return f"""
tok AS (SELECT unnest(regexp_extract_all(text, '{PAT}')) AS token FROM {table}),
cnt AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 1 AS INTEGER) AS token_id, cnt
  FROM cnt)"""


def sql_token_rows(table="documents", key="doc_id") -> str:
    """(key, i, token_id) for every token of every row, plus per-row counts."""
    return f"""
toks AS (SELECT {key} AS k, regexp_extract_all(text, '{PAT}') AS toks FROM {table}),
pos AS (SELECT k, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM toks),
ids AS (SELECT p.k, p.i, coalesce(v.token_id, 0) AS token_id FROM pos p LEFT JOIN vocab v USING (token))"""


def sql_stream(table="documents", key="doc_id") -> str:
    return sql_vocab(table) + "," + sql_token_rows(table, key) + """,
lens AS (SELECT k, len(toks) AS n FROM toks),
starts AS (SELECT k, n, sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS st FROM lens),
stream AS (SELECT ids.k, ids.token_id, starts.st + ids.i - 1 AS gpos FROM ids JOIN starts USING (k))"""


def sql_chunks(C: int) -> str:
    return f"""
SELECT CAST(gpos // {C} AS BIGINT) AS chunk_id, CAST(count(*) AS INTEGER) AS n_tokens,
       md5(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY gpos)) AS ids_md5
FROM stream GROUP BY 1 HAVING count(*) = {C}"""


# ---- S ---------------------------------------------------------------------

@register("s1_corpus_scan", sql="""
SELECT doc_id, CAST(length(text) AS INTEGER) AS text_chars, md5(text) AS text_md5 FROM documents""")
def s1_corpus_scan(spark, sf):
    return docs(spark, sf).select("doc_id", F.length("text").alias("text_chars"), F.md5("text").alias("text_md5"))


@register("s2_first_n", sql=f"""
SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT {HEAD_ROWS}""")
def s2_first_n(spark, sf):
    conv = corpus.read_table(spark, sf, "conversations")
    return corpus.take_first(conv, HEAD_ROWS, ["conv_id", "turn"]).select("conv_id", "turn", "role")


@register("s3_keep_columns", sql="WITH " + sql_vocab() + "," + sql_token_rows() + """
SELECT d.doc_id, d.lang, d.source, CAST(coalesce(l.n, 0) AS INTEGER) AS n_tokens
FROM documents d LEFT JOIN (SELECT k, count(*) AS n FROM ids GROUP BY k) l ON l.k = d.doc_id""")
def s3_keep_columns(spark, sf):
    d = corpus.read_corpus(spark, f"{sf}/documents.parquet", keep=["lang", "source"])
    enc = tokenize.encode(d, tokenize.build_vocab(d, "text"), keep_columns=True)
    return enc.select("doc_id", "lang", "source", F.size("input_ids").alias("n_tokens"))


@register("s4_chunk_sink", sql="WITH " + sql_stream() + sql_chunks(CHUNK_LEN))
def s4_chunk_sink(spark, sf):
    """Writes chunks under ``chunked_context{C}`` and reads them back."""
    tok = encoded(spark, sf)
    off = pack.token_offsets(tok)
    root = scratch_path(spark, "chunks")
    path = sinks.write_chunks(pack.pack_chunks(off, CHUNK_LEN), root, CHUNK_LEN)
    back = spark.read.parquet(path)
    return back.select("chunk_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))


@register("s4_chunk_store", sql="WITH " + sql_stream() + sql_chunks(CHUNK_LEN))
def s4_chunk_store(spark, sf):
    """Chunks appended in two commits and read back as three ranges, one of them across the commits."""
    chunks = pack.pack_chunks(pack.token_offsets(encoded(spark, sf)), CHUNK_LEN)
    whole = written(spark, chunks, "chunks")
    n = whole.count()
    store = ChunkStore(spark, scratch_path(spark, "chunk-store"))
    store.append(whole.where(F.col("chunk_id") < n // 2))
    store.append(whole.where(F.col("chunk_id") >= n // 2))
    rows = whole.limit(0)
    for lo, hi in ((0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, None)) if n else ():
        rows = rows.unionByName(store.read(lo, hi))
    return rows.select("chunk_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))


# ---- T ---------------------------------------------------------------------

@register("t1_vocab", sql="WITH " + sql_vocab() + " SELECT token, token_id, cnt FROM vocab")
def t1_vocab(spark, sf):
    return vocab_df(spark, sf)


@register("t2_encode", sql="WITH " + sql_vocab() + "," + sql_token_rows() + """
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_tokens, md5(coalesce(a.s, '')) AS ids_md5
FROM documents d LEFT JOIN (
  SELECT k, count(*) AS n, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY i) AS s FROM ids GROUP BY k
) a ON a.k = d.doc_id""")
def t2_encode(spark, sf):
    return encoded(spark, sf).select("doc_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))


@register("t3_truncate", sql="WITH " + sql_vocab() + "," + sql_token_rows() + f"""
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_tokens, md5(coalesce(a.s, '')) AS ids_md5
FROM documents d LEFT JOIN (
  SELECT k, count(*) AS n, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY i) AS s FROM ids
  WHERE i <= {TRUNCATE_AT} GROUP BY k
) a ON a.k = d.doc_id""")
def t3_truncate(spark, sf):
    return encoded(spark, sf, max_length=TRUNCATE_AT).select(
        "doc_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))


@register("t4_append_eos", sql="WITH " + sql_vocab() + "," + sql_token_rows() + f"""
SELECT d.doc_id, CAST(coalesce(a.n, 0) + 1 AS INTEGER) AS n_tokens, {tokenize.EOS_ID} AS last_id
FROM documents d LEFT JOIN (SELECT k, count(*) AS n FROM ids GROUP BY k) a ON a.k = d.doc_id""")
def t4_append_eos(spark, sf):
    return encoded(spark, sf, append_eos=True).select(
        "doc_id", F.size("input_ids").alias("n_tokens"), F.element_at("input_ids", -1).alias("last_id"))


@register("t5_id_range", sql="WITH " + sql_vocab() + "," + sql_token_rows() + """
SELECT k AS doc_id, max(token_id) AS max_id FROM ids GROUP BY k""")
def t5_id_range(spark, sf):
    checked = tokenize.assert_id_range(encoded(spark, sf), "uint32")
    return checked.filter(F.size("input_ids") > 0).select("doc_id", F.array_max("input_ids").alias("max_id"))


@register("t6_eligible_words", sql="WITH " + sql_vocab() + """
SELECT DISTINCT token AS word FROM vocab WHERE regexp_full_match(token, '[a-zA-Z]{3,}')""")
def t6_eligible_words(spark, sf):
    return tokenize.eligible_words(vocab_df(spark, sf))


# ---- C ---------------------------------------------------------------------

@register("c1_token_offsets", sql="WITH " + sql_stream() + """
SELECT k AS doc_id, n AS n_tokens, st AS start FROM starts""")
def c1_token_offsets(spark, sf):
    off = pack.token_offsets(encoded(spark, sf))
    return off.select("doc_id", "n_tokens", "start")


@register("c2_pack_chunks", sql="WITH " + sql_stream() + sql_chunks(CHUNK_LEN))
def c2_pack_chunks(spark, sf):
    off = pack.token_offsets(encoded(spark, sf))
    ch = pack.pack_chunks(off, CHUNK_LEN)
    return ch.select("chunk_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))


@register("c3_packing_stats", sql="WITH " + sql_vocab() + "," + sql_token_rows() + f"""
SELECT {CHUNK_LEN} AS chunk_len, CAST(count(*) AS BIGINT) AS total_tokens,
  CAST(count(*) // {CHUNK_LEN} * {CHUNK_LEN} AS BIGINT) AS usable_tokens,
  CAST(count(*) % {CHUNK_LEN} AS BIGINT) AS dropped_tokens, CAST(count(*) // {CHUNK_LEN} AS BIGINT) AS num_chunks
FROM ids""")
def c3_packing_stats(spark, sf):
    return pack.packing_stats(encoded(spark, sf), CHUNK_LEN)


@register("c4_multi_length", sql="WITH " + sql_stream() + " " + " UNION ALL ".join(
    f"SELECT {C} AS chunk_len, * FROM ({sql_chunks(C)})" for C in STAGE_LENGTHS))
def c4_multi_length(spark, sf):
    off = pack.token_offsets(encoded(spark, sf))
    ch = pack.pack_many(off, STAGE_LENGTHS)
    return ch.select("chunk_len", "chunk_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))


@register("c5_cached_offsets", sql="WITH " + sql_stream("benchmark", "item_id") + """,
cat AS (SELECT k, md5(coalesce(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY gpos), '')) AS ids_md5 FROM stream GROUP BY k)
SELECT starts.k AS item_id, n AS n_tokens, st AS start, coalesce(cat.ids_md5, md5('')) AS ids_md5, true AS reused FROM starts LEFT JOIN cat USING (k)""")
def c5_cached_offsets(spark, sf):
    """Tokens and offsets of a second corpus (``benchmark``, its own vocabulary), asked for twice:
    the second time they come from the cache, and nothing is tokenised."""
    b = corpus.read_corpus(spark, f"{sf}/benchmark.parquet", "text", "item_id")
    root = scratch_path(spark, "offsets")

    def make():
        return pack.token_offsets(tokenize.encode(b, tokenize.build_vocab(b, "text")), "item_id")

    for _ in range(2):
        cached, hit = pack.cached_offsets(spark, root, tuple(pack.corpus_fingerprint(b, "item_id").first()), make)
    return cached.select("item_id", "n_tokens", "start", ids_md5().alias("ids_md5"), F.lit(hit).alias("reused"))


def _grown(spark, sf):
    """A store that first saw the documents up to the middle id, and then all of them; and its version before."""
    d = docs(spark, sf)
    vocab = tokenize.build_vocab(d, "text")
    store = TokenStore(spark, scratch_path(spark, "store"), lambda part: tokenize.encode(part, vocab))
    cut = d.agg(F.max("doc_id")).first()[0] // 2
    first = store.sync(d.filter(F.col("doc_id") <= cut))
    store.sync(d)
    return store, first["version"], cut


@register("c5_growing_corpus", sql="WITH " + sql_stream() + """,
cat AS (SELECT k, md5(coalesce(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY gpos), '')) AS ids_md5 FROM stream GROUP BY k)
SELECT starts.k AS doc_id, n AS n_tokens, st AS start, coalesce(cat.ids_md5, md5('')) AS ids_md5, starts.k > (SELECT max(doc_id) // 2 FROM documents) AS appended
FROM starts LEFT JOIN cat USING (k)""")
def c5_growing_corpus(spark, sf):
    """The second half of the corpus is appended: it alone is tokenised, and its offsets go on from the stored ones."""
    store, _, cut = _grown(spark, sf)
    return store.read().select("doc_id", "n_tokens", "start", ids_md5().alias("ids_md5"), (F.col("doc_id") > cut).alias("appended"))


@register("c5_new_chunks", sql="WITH " + sql_stream() + f""",
c AS ({sql_chunks(CHUNK_LEN)})
SELECT * FROM c WHERE chunk_id >= (SELECT sum(n) FROM starts WHERE k <= (SELECT max(doc_id) // 2 FROM documents)) // {CHUNK_LEN}""")
def c5_new_chunks(spark, sf):
    """The chunks that the appended half completes or adds."""
    store, before, _ = _grown(spark, sf)
    return store.new_chunks(CHUNK_LEN, before).select("chunk_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))


# ---- subwords: the tokenizer slot with a public vocabulary file ----------------------

def subword_file(name: str = "byte_bpe_50k.json") -> bytes:
    """A public vocabulary file of the installed package; any other file of the kind can be passed in its place."""
    import public_tokenizers

    return tokenize.read_vocabulary(public_tokenizers.path(name))


@register("t2_subword_encode")
def t2_subword_encode(spark, sf):
    """Subword ids of every document, and whether they decode to its text."""
    model = subword_file()
    enc = tokenize.encode_subwords(docs(spark, sf), model, keep_text=True)
    back = tokenize.decode_subwords(enc, model)
    return back.select("doc_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"), (F.col("decoded") == F.col("text")).alias("round_trip"))


@register("c2_subword_chunks")
def c2_subword_chunks(spark, sf):
    off = pack.token_offsets(tokenize.encode_subwords(docs(spark, sf), subword_file()))
    return pack.pack_chunks(off, CHUNK_LEN).select("chunk_id", F.size("input_ids").alias("n_tokens"), ids_md5().alias("ids_md5"))
