"""Deterministic draws from md5.

Every random choice in the task generators and the epoch shuffle is a pure
function of ``(seed, key parts...)``: the hex prefix of ``md5`` read as a
32-bit unsigned integer.  That makes results independent of partitioning and
of re-execution after a lost executor, and lets a SQL engine repeat them
(DuckDB: ``('0x' || substr(md5(s), 1, 8))::BIGINT``).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0

try:
    _MD5 = hashlib.md5  # the plain call is the quickest
    _MD5(b"")
except ValueError:  # where md5 is only let through for such uses as this
    _MD5 = functools.partial(hashlib.md5, usedforsecurity=False)


def _key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash32(seed, *parts) -> Column:
    """Unsigned 32-bit integer (as BIGINT) from md5 of ``seed:part:...``."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(seed, *parts) / F.lit(TWO_32)


def randint(lo, hi, seed, *parts) -> Column:
    """Integer in [lo, hi] inclusive (``lo``/``hi`` may be columns)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(uniform(seed, *parts) * (hi_c - lo_c + 1))).cast("bigint")


def draws(seed, tag: str, key, tails) -> np.ndarray:
    """:func:`hash32` of ``seed:tag:key:tail`` for each of ``tails``, for use inside an Arrow function.

    ``key`` is a row's key as text; None is left out of the digest, as the column form leaves a null out."""
    head = (f"{seed}:{tag}:" if key is None else f"{seed}:{tag}:{key}:").encode()
    ends = _texts(len(tails)) if tails == range(len(tails)) else [str(t).encode() for t in tails]
    md5 = _MD5
    return np.frombuffer(b"".join([md5(head + t).digest() for t in ends]), ">u4")[::4].astype(np.int64)


@functools.lru_cache
def _texts(n: int) -> list:
    """0 .. n - 1 as text."""
    return [b"%d" % i for i in range(n)]


def hash_array(seed, tag: str, key: Column, k: int) -> Column:
    """``array(hash32(seed, tag, key, 0), ..., hash32(seed, tag, key, k - 1))``, drawn in Arrow batches.

    The column form costs a chain of string expressions a draw, which inside a lambda is interpreted; from some ten draws
    a row this is several times cheaper."""
    @F.arrow_udf("array<bigint>")
    def hashed(keys: pa.Array) -> pa.Array:
        flat = [draws(seed, tag, x, range(k)) for x in keys.to_pylist()]
        values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * k), pa.array(values))

    return hashed(key.cast("string"))


ROUNDS, WALK = 6, 64


def permuted(x: str, n: str, *tag: str) -> Column:
    """The place of ``x`` (a long in [0, n)) in a keyed permutation of [0, n), computed in the row.

    ``x``, ``n`` and the parts of the key are SQL texts. [0, n) lies in a grid of ``a = ceil(sqrt(n))`` by
    ``b = ceil(n / a)`` cells. Each of six rounds shifts one coordinate by an md5 of the other, which can be undone, so a
    pass permutes the grid; a cell beyond ``n`` is passed again until it lies inside (cycle walking). Fewer
    than ``a`` cells lie beyond, which bounds the walk for small ``n``; for n > 4,096 it would take more than 64 passes
    with a probability below 64 ** -64, and the row then fails rather than being placed twice.
    """
    a = f"cast(ceil(sqrt({n})) as bigint)"
    b = f"(({n} + {a} - 1) div {a})"

    def shift(i: str, v: str) -> str:
        key = ", ".join(f"cast({p} as string)" for p in (*tag, i, v))
        return f"cast(conv(substr(md5(concat_ws(':', {key})), 1, 15), 16, 10) as bigint)"

    one = f"""aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', y div {b}, 'r', y % {b}),
        (s, i) -> if(i % 2 = 0, named_struct('l', (s.l + {shift('i', 's.r')}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {shift('i', 's.l')}) % {b})),
        s -> s.l * {b} + s.r)"""
    # the first pass is always made, so the walk starts beyond n
    walked = f"aggregate(sequence(0, {WALK}), {n} + cast({x} as bigint), (w, k) -> if(w < {n}, w, element_at(transform(array(if(k = 0, w - {n}, w)), y -> {one}), 1)))"
    return F.expr(f"element_at(transform(array({walked}), w -> if(w < {n}, w, cast(raise_error('a walk did not end') as bigint))), 1)")


def sql_permuted(table: str, keys: list[str], x: str, n: str, *tag: str, out: str = "pos") -> str:
    """DuckDB text of CTEs ``walk`` and ``permuted`` (keys, ``out``) over ``table``; ``n`` may be a column of it."""
    names = ", ".join(keys)
    step = "SELECT *, y // b AS l0, y % b AS r0 FROM walk WHERE k = 0 OR y >= n"
    for i in range(ROUNDS):
        key = " || ':' || ".join([f"CAST({p} AS VARCHAR)" for p in tag] + [f"'{i}'"])
        old, other = (f"l{i}", f"r{i}") if i % 2 == 0 else (f"r{i}", f"l{i}")
        new = f"({old} + ('0x' || substr(md5({key} || ':' || {other}), 1, 15))::BIGINT) % {'a' if i % 2 == 0 else 'b'}"
        pair = (new, other) if i % 2 == 0 else (other, new)
        step = f"SELECT *, {pair[0]} AS l{i + 1}, {pair[1]} AS r{i + 1} FROM ({step})"
    return f"""
walk AS (
  SELECT {names}, n, a, (n + a - 1) // a AS b, y, CAST(0 AS BIGINT) AS k FROM (SELECT *, {n} AS n, CAST(ceil(sqrt({n})) AS BIGINT) AS a, CAST({x} AS BIGINT) AS y FROM {table})
  UNION ALL
  SELECT {names}, n, a, b, l{ROUNDS} * b + r{ROUNDS}, k + 1 FROM ({step})),
permuted AS (SELECT {names}, y AS {out} FROM walk WHERE k > 0 AND y < n)"""


def sql_hash32(seed, *parts_sql: str) -> str:
    """DuckDB text of :func:`hash32` for oracle queries."""
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts_sql])
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def sql_uniform(seed, *parts_sql: str) -> str:
    return f"({sql_hash32(seed, *parts_sql)} / {TWO_32})"


def sql_randint(lo, hi, seed, *parts_sql: str) -> str:
    return f"(({lo}) + floor({sql_uniform(seed, *parts_sql)} * (({hi}) - ({lo}) + 1)))::BIGINT"
