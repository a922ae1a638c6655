"""Vocabulary build, encoding, truncation, EOS, id-range check, word filter.

The tokenizer slot has two implementations:
  * the built-in word tokenizer (``WORD_TOKEN_PATTERN``) whose vocabulary is
    counted by a Spark job (T1); T2 looks each block's distinct tokens up in it;
  * a subword vocabulary file of the ``tokenizers`` library (``encode_subwords``), or any Python
    encoder (``encode_with``), row-local via ``mapInArrow``.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from contextlib import contextmanager
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import prefix
from ..functions.text import WORD_TOKEN_PATTERN, py_strip
from ..session import scratch_path

# Reserved ids of the built-in vocabulary.
UNK_ID = 0
EOS_ID = 1
RESERVED = 2

BROADCAST_TOKENS, BROADCAST_BYTES = 500_000, 16 << 20
BLOCK_TOKENS, BATCH_ROWS = 500_000, 1000  # of one block, and of the batches that blocks are cut from

DTYPE_MAX = {"uint16": 65535, "uint32": 4294967295, "int32": 2147483647}


def word_tokens(text_col: str = "text") -> F.Column:
    """Array of word/punctuation tokens (JVM regex, whole text)."""
    return F.regexp_extract_all(F.col(text_col), F.lit(WORD_TOKEN_PATTERN), 0)


def build_vocab(df: DataFrame, text_col: str = "text", max_size: int | None = None,
                min_count: int = 1) -> DataFrame:
    """Token -> id from corpus counts, all tokens unless ``max_size`` says otherwise.

    ``explode`` + ``groupBy.count`` aggregates partially on the map side (a hot
    token costs one row per partition).  Ids are dense after the reserved ones
    in the order (count desc, token), by a two-level index; no task sorts them all.
    The corpus is read once and the table written to the shared folder, so later steps read it from there.
    Output: ``token STRING, token_id INT, cnt LONG``.
    """
    counts = (df.select(F.explode(word_tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
              .filter(F.col("cnt") >= min_count))
    ids = prefix.dense_index(counts, [F.col("cnt").desc(), F.col("token")], "_pos")
    if max_size is not None:
        ids = ids.filter(F.col("_pos") < max_size)
    path = scratch_path(df.sparkSession, "vocab")
    ids.select("token", (F.col("_pos") + RESERVED).cast("int").alias("token_id"), "cnt").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _word_encoder(vocab: dict, unk: int):
    import regex

    pat = regex.compile(WORD_TOKEN_PATTERN)

    def encode(texts: list) -> list:
        get = vocab.get
        return [None if t is None else [get(w, unk) for w in pat.findall(t)] for t in texts]

    return encode


KEYS = ("doc_id", "conv_id", "item_id", "id")
ENCODE_ROWS, ENCODE_BYTES, DECODE_IDS = 1024, 1 << 20, 1 << 18  # of one call of an encoder or decoder


def _runs(sizes: pa.Array, rows: int, limit: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose sizes add up to ``limit`` at most, or of one larger row."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right"))
        j = min(max(i + 1, j), i + rows)
        yield i, j
        i = j


def encode(df: DataFrame, vocab: dict | DataFrame, text_col: str = "text",
           out_col: str = "input_ids", keep_columns: bool = False,
           max_length: int | None = None, append_eos: bool = False) -> DataFrame:
    """T2 (+T3, T4): text -> ``ARRAY<INT>`` with the built-in word tokenizer.

    Rows stay rows, whatever their ids; a null or empty text gives an empty array. Texts are split by
    the same JVM pattern that counted the vocabulary. A vocabulary table of at most ``BROADCAST_TOKENS`` tokens and
    ``BROADCAST_BYTES`` goes to the tasks (:func:`encode_by_table`: no exchange at all); a larger one is joined to
    the distinct tokens of blocks of rows (:func:`encode_by_join`). A ``dict`` that the caller
    holds anyway goes to the executors as a broadcast variable, row-local over Arrow batches.
    """
    if isinstance(vocab, DataFrame):
        n, size = vocab.agg(F.count("token"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
        by = encode_by_table if n <= BROADCAST_TOKENS and size <= BROADCAST_BYTES else encode_by_join
        out = by(df, vocab, text_col, out_col, keep_columns)
    else:
        bvocab = df.sparkSession.sparkContext.broadcast(vocab)
        factory = lambda: _word_encoder(bvocab.value, UNK_ID)
        out = encode_with(df, factory, text_col, out_col, keep_columns)
    if max_length:
        out = truncate(out, max_length, out_col)
    if append_eos:
        out = add_eos(out, EOS_ID, out_col)
    return out


def encode_with(df: DataFrame, encoder_factory: Callable[[], Callable[[list], list]],
                text_col: str = "text", out_col: str = "input_ids",
                keep_columns: bool = False) -> DataFrame:
    """Tokenizer slot: ``encoder_factory()`` is called once per task on the
    executor and returns ``list[str|None] -> list[list[int]|None]`` (for a
    ``tokenizers.Tokenizer``: ``lambda ts: [e.ids for e in tok.encode_batch(ts)]``). It gets
    runs of at most ``ENCODE_ROWS`` texts and ``ENCODE_BYTES``, or one longer text, so what a task holds follows
    neither the rows of an Arrow batch nor the table."""
    keep = [f for f in df.schema.fields if f.name != text_col] if keep_columns else \
        [f for f in df.schema.fields if f.name != text_col and f.name in KEYS]
    keep_names = [f.name for f in keep]
    schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.IntegerType()), True)])
    arrow_type = pa.list_(pa.int32())
    src = df.select(*keep_names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_factory()
        for b in batches:
            for i, j in _runs(pc.binary_length(b.column(text_col)), ENCODE_ROWS, ENCODE_BYTES):
                part = b.slice(i, j - i)
                ids = pa.array(enc(part.column(text_col).to_pylist()), type=arrow_type)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in keep_names] + [ids], names=keep_names + [out_col])

    return src.mapInArrow(run, schema)


# ---- subwords: a vocabulary file of the ``tokenizers`` library in the slot -------------

def read_vocabulary(path: str) -> bytes:
    """A tokenizer file; its size doesn't depend on the corpus."""
    with open(path, "rb") as f:
        return f.read()


_tokenizers: dict = {}  # of the process: tokenizers by the digest of their file


def _subwords(model: bytes):
    name = hashlib.sha256(model).hexdigest()
    if name not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model.decode())
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        _tokenizers[name] = tok
    return _tokenizers[name]


def encode_subwords(df: DataFrame, model: bytes, text_col: str = "text", out_col: str = "input_ids", keep_columns: bool = False,
                    keep_text: bool = False, max_length: int | None = None, eos_id: int | None = None) -> DataFrame:
    """T2 (+T3, T4) with a subword vocabulary file, row-local: no special tokens are added but ``eos_id`` where one
    is given. A null or empty text gives an empty array (and the end, if asked for)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # one vocabulary file

    def factory():
        tok = _subwords(shared.value)
        return lambda texts: [e.ids for e in tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    src = df.withColumn("_source", F.col(text_col)) if keep_text else df
    keep = keep_columns or keep_text
    out = encode_with(src.select(*[c for c in src.columns if keep_columns or c in (*KEYS, text_col, "_source")]), factory, text_col, out_col, keep)
    if keep_text:
        out = out.withColumnRenamed("_source", text_col)
    if max_length:
        out = truncate(out, max_length, out_col)
    return out if eos_id is None else add_eos(out, eos_id, out_col)


def decode_subwords(df: DataFrame, model: bytes, ids_col: str = "input_ids", out_col: str = "decoded") -> DataFrame:
    """The text of each row's ids, special tokens left out."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # one vocabulary file
    names = [*df.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _subwords(shared.value)
        for b in batches:
            for i, j in _runs(pc.list_value_length(b.column(ids_col)), ENCODE_ROWS, DECODE_IDS):
                part = b.slice(i, j - i)
                texts = tok.decode_batch([x or [] for x in part.column(ids_col).to_pylist()], skip_special_tokens=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def subword_vocabulary(spark, model: bytes) -> DataFrame:
    """T1 for a vocabulary file: (token, token_id), each entry decoded to the text it stands for (T6 reads it)."""
    tok = _subwords(model)
    ids = sorted(tok.get_vocab().values())
    return spark.createDataFrame(list(zip(tok.decode_batch([[i] for i in ids], skip_special_tokens=False), ids)), "token string, token_id int")


def _tokenised(df: DataFrame, text_col: str, keep_columns: bool) -> tuple[DataFrame, list]:
    """The kept columns and, last, the tokens of each text; and the kept fields."""
    keep = [f for f in df.schema.fields if f.name != text_col and (keep_columns or f.name in KEYS)]
    tokens = F.coalesce(word_tokens(text_col), F.array().cast("array<string>"))
    return df.select(*[F.col(f.name) for f in keep], tokens.alias("_tokens")), keep


def _distinct(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of a column, the place of each token among them, and where each row begins."""
    flat = tokens.flatten().dictionary_encode()
    sizes = pc.list_value_length(tokens).to_numpy()
    return flat.dictionary, flat.indices.to_numpy(), np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)


_maps: dict = {}  # of the worker process: vocabularies by broadcast


def encode_by_table(df: DataFrame, vocab: DataFrame, text_col: str = "text", out_col: str = "input_ids",
                    keep_columns: bool = False) -> DataFrame:
    """T2 with a vocabulary of proven size, row-local: a batch's distinct tokens are looked up once each."""
    src, keep = _tokenised(df, text_col, keep_columns)
    table = vocab.select("token", "token_id").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    shared = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())  # checked by the caller
    name = uuid.uuid4().hex
    names = [f.name for f in keep] + [out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _maps:
            _maps.clear()
            rows = pa.ipc.open_stream(shared.value).read_all()
            _maps[name] = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
        get = _maps[name].get
        for b in batches:
            for i, j in _runs(pc.list_value_length(b.column(len(keep))), len(b), BLOCK_TOKENS):
                part = b.slice(i, j - i)
                tokens, place, at = _distinct(part.column(len(keep)))
                ids = np.array([get(t, UNK_ID) for t in tokens.to_pylist()], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids[place] if len(place) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], names=names)

    return src.mapInArrow(run, T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.IntegerType()), True)]))


@contextmanager
def _batches_of(spark, rows: int) -> Iterator[None]:
    """Inside, Arrow batches have at most so many rows (fewer where the session says so)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def encode_by_join(df: DataFrame, vocab: DataFrame, text_col: str = "text", out_col: str = "input_ids",
                   keep_columns: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """T2 for a vocabulary of any size: only the distinct tokens of a block of rows meet it.

    A block (rows of one Arrow batch with at most ``block_tokens`` tokens, or one longer row) is all that a task of Python
    holds, whatever the table's size. It is written to the shared folder once, with its tokens as places in its own list of distinct ones. Those lists are joined to the
    vocabulary, so a token crosses the network once a block, and their ids return to their block. A frequent token
    is a skewed join key, with a row for each block, which AQE splits.
    """
    spark = df.sparkSession
    src, keep = _tokenised(df, text_col, keep_columns)
    kept = [f.name for f in keep]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b.column(len(keep))).to_numpy())
            i = 0
            while i < len(b):
                first = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, first + block_tokens, side="right")))
                part = b.slice(i, j - i)
                tokens, place, at = _distinct(part.column(len(keep)))
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays(part.columns[: len(keep)] + [pa.array(np.diff(at))], names=[*kept, "_size"])
                with pa.ipc.new_stream(sink, rows.schema) as w:
                    w.write_batch(rows)
                block = TaskContext.get().partitionId() << 32 | n
                n, i = n + 1, j
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([place.astype("<i4", copy=False).tobytes()], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens.cast(pa.string()))], names=["block", "rows", "places", "tokens"])

    path = scratch_path(spark, "blocks")
    with _batches_of(spark, BATCH_ROWS):
        src.mapInArrow(pack, "block long, rows binary, places binary, tokens array<string>").write.parquet(path)
    blocks = spark.read.parquet(path)
    words = blocks.select(F.col("block").alias("of"), F.posexplode("tokens").alias("i", "token"))
    ids = words.join(vocab.select("token", "token_id"), "token").select("of", "i", "token_id")
    schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.IntegerType()), True)])

    def unpack(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            rows = pa.ipc.open_stream(r["rows"]).read_all()
            place = np.frombuffer(r["places"], "<i4")
            known = np.full(int(place.max(initial=-1)) + 1, UNK_ID, dtype=np.int32)
            known[right.column("i").to_numpy()] = right.column("token_id").to_numpy()
            at = np.concatenate(([0], np.cumsum(rows.column("_size").to_numpy()))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(known[place]))
            out.append(pa.table([*rows.columns[: len(keep)], lists], names=[*kept, out_col]))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return blocks.select("block", "rows", "places").groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(unpack, schema)


def truncate(df: DataFrame, max_length: int, col: str = "input_ids") -> DataFrame:
    """Keep the first ``max_length`` ids (before any concatenation)."""
    return df.withColumn(col, F.slice(F.col(col), 1, int(max_length)))


def add_eos(df: DataFrame, eos_id: int = EOS_ID, col: str = "input_ids") -> DataFrame:
    """T4: one EOS closes each record."""
    return df.withColumn(col, F.array_append(F.col(col), F.lit(int(eos_id))))


def assert_id_range(df: DataFrame, dtype: str = "uint32", col: str = "input_ids") -> DataFrame:
    """T5: checked narrowing.  Fails the job (instead of wrapping) when an id
    does not fit ``dtype``; the check runs inside the plan, no extra pass."""
    hi = DTYPE_MAX[dtype]
    bad = (F.array_max(col) > F.lit(hi)) | (F.array_min(col) < F.lit(0))
    return df.withColumn(col, F.when(bad, F.raise_error(F.lit(f"token id out of range for {dtype}")))
                         .otherwise(F.col(col)))


def eligible_words(vocab: DataFrame, need: int | None = None, token_col: str = "token") -> DataFrame:
    """Vocabulary entries that, once stripped, are 3+ ASCII letters
    (distinct).  ``need`` makes the job fail when fewer words exist."""
    w = py_strip(F.col(token_col))
    out = vocab.select(w.alias("word")).filter(F.col("word").rlike("^[a-zA-Z]{3,}$")).distinct()
    if need:
        n = out.count()
        if n < need:
            raise ValueError(f"only {n} eligible words, {need} are needed")
    return out
