"""Vectorised helpers on the UTF-8 bytes of Arrow string columns.

A block is a run of rows whose texts hold at most ``BLOCK`` bytes together (or one longer text);
words and their 64-bit hashes come from whole-block NumPy passes, never from a per-word loop.
Working memory is about forty times ``BLOCK`` plus sixteen bytes for each word of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 & ~0x7 | 0x5  # 5 mod 8: odd powers stay far apart
_M64 = (1 << 64) - 1

_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)

#: Bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for every position of a block."""
    if not _tables:
        with np.errstate(over="ignore"):
            for name, b in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
                t = np.full(BLOCK + 1, b, dtype=np.uint64)
                t[0] = 1
                _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def batch_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches have at most so many rows: each is held by the JVM and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts (one more at the end); null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kinds = (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)
    if not any(f(col.type) for f in kinds):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)  # no copy
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends of all words, and at which word each row begins (one more at the end)."""
    inside = ~space[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (sorted, not overlapping)."""
    power, inverse = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            at = int(starts[i])
            j = int(np.searchsorted(ends, at + BLOCK, "right"))
            if j > i:
                part = buf[at : int(ends[j - 1])]
                total = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
                s, e = starts[i:j] - at, ends[i:j] - at
                out[i:j] = (total[e] - total[s]) * inverse[s]
            else:  # one span longer than a block
                j, h = i + 1, 0
                for o in range(at, int(ends[i]), BLOCK):
                    part = buf[o : min(o + BLOCK, int(ends[i]))]
                    h += pow(_BASE, o - at, 1 << 64) * int((_BYTE[part] * power[: len(part)]).sum())
                out[i] = h & _M64
            i = j
        return mix(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each row, and where each row's begin (one more at the end).

    ``at``: where each row's words begin. A row with fewer words has its whole sequence as one
    shingle, a row without words has none.
    """
    n = np.diff(at)
    with np.errstate(over="ignore"):
        short = (n > 0) & (n < k)
        size = np.where(short, 1, np.maximum(n - k + 1, 0))
        to = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(to[-1], dtype=np.uint64)
        if len(words) >= k:
            roll = words[: len(words) - k + 1].copy()
            for j in range(1, k):
                roll *= _U(0xD1342543DE82EF95)
                roll += words[j : len(words) - k + 1 + j]
            where = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], size)
            whole = np.repeat(~short, size)
            out[whole] = roll[where[whole]]
        for r in np.flatnonzero(short):
            h = _U(int(n[r]))
            for w in words[at[r] : at[r + 1]]:
                h = h * _U(0xD1342543DE82EF95) + w
            out[to[r]] = h
        return mix(out), to


class SpanCache:
    """A direct-mapped table from 64-bit keys to values, bounded in size; a newer key replaces an older one."""

    def __init__(self, bits: int = 20):
        self.mask = _U((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.full = np.zeros(1 << bits, dtype=bool)
        self.values = np.zeros(1 << bits, dtype=np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (keys & self.mask).astype(np.int64)
        return self.values[slot], self.full[slot] & (self.keys[slot] == keys)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys & self.mask).astype(np.int64)
        self.keys[slot], self.values[slot], self.full[slot] = keys, values, True
        kept = self.keys[slot] == keys  # of keys with one slot the last stays, with its own value
        self.values[slot[kept]] = values[kept]

    def clear(self) -> None:
        self.full[:] = False
