"""Token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is cut into blocks of equal bytes, texts are split at safe boundaries, and the
``tokenizers`` library encodes the distinct pieces of a block in one batch call.

* A tokenizer that drops white space (probed, not assumed) may be cut at every run of ASCII white
  space: nothing of its normaliser, pattern or merges reaches across one. Each distinct piece is
  then encoded once for a block, and a bounded table keeps the lengths of recent pieces.
* Any other tokenizer gets whole texts; a text longer than ``long_text`` bytes is split before a
  single space that stands between two ASCII letters, where a byte-level pattern always begins a
  new token. Where there is no such place the text stays whole.

Null or empty text: 0 bytes, 0 tokens. Strings of special tokens inside texts count as the library
takes them by default. Repeated rows give repeated results; an empty table gives an empty result;
other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytewords as B

LONG_TEXT = 1 << 18
_SAFE = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


def read_model(path: str) -> bytes:
    """A vocabulary file; its size doesn't depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def _tokenizer(model: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model.decode("utf-8"))
    tok.no_truncation()
    tok.no_padding()
    return tok


def lengths(tok, texts: list[str]) -> np.ndarray:
    return np.fromiter((len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)), np.int64, len(texts))


def drops_white_space(tok) -> bool:
    """Whether pieces between ASCII white space can be encoded one by one."""
    parts = ["Ab", "c1", "...", "é", "x"]
    for sep in (" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n "):
        if len(tok.encode(sep, add_special_tokens=False)) or not np.array_equal(
            tok.encode(sep.join(parts), add_special_tokens=False).ids,
            sum((tok.encode(p, add_special_tokens=False).ids for p in parts), []),
        ):
            return False
    return True


def _by_piece(tok) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    cache = B.SpanCache()

    def count(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, at = B.word_spans(buf, offsets)
        keys = B.span_hashes(buf, starts, ends)
        found, hit = cache.find(keys)
        if not hit.all():
            missed = np.flatnonzero(~hit)
            new, first, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            raw, where = buf.tobytes(), missed[first]
            n = lengths(tok, [raw[s:e].decode("utf-8") for s, e in zip(starts[where], ends[where])])
            found[missed] = n[back]
            cache.put(new, n)
        total = np.concatenate(([0], np.cumsum(found)))
        return total[at[1:]] - total[at[:-1]]

    return count


def _by_text(tok, long_text: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def pieces(text: str) -> list[str]:
        if len(text) <= long_text:
            return [text]
        cuts, last = [0], 0
        for m in _SAFE.finditer(text):
            if m.start() - last >= long_text:
                cuts.append(last := m.start())
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def count(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = buf.tobytes()
        parts = [pieces(raw[a:b].decode("utf-8")) for a, b in zip(offsets[:-1], offsets[1:])]
        n = np.concatenate(([0], np.cumsum(lengths(tok, [p for x in parts for p in x]))))
        ends = np.cumsum([len(x) for x in parts])
        return n[ends] - n[ends - [len(x) for x in parts]]

    return count


@lru_cache(maxsize=1)
def counter(model: bytes, long_text: int = LONG_TEXT) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from bytes and row offsets to the token count of each row; kept between the tasks of a Python worker."""
    tok = _tokenizer(model)
    return _by_piece(tok) if drops_white_space(tok) else _by_text(tok, long_text)


def token_counts(spark: SparkSession, docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text",
                 long_text: int = LONG_TEXT) -> DataFrame:
    """Of each row: key, ``n_bytes`` (UTF-8) and ``n_tokens``. ``model``: the JSON file of a tokenizer."""
    shared = spark.sparkContext.broadcast(model)  # one vocabulary file
    B.batch_rows(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = counter(shared.value, long_text)
            buf, offsets = B.text_bytes(batch.column(1))
            n = [of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in B.blocks(offsets)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))],
                                  names=["key", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, schema)
            .withColumnRenamed("key", key))
