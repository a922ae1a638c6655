"""Centroid clustering against plain integers, and the simplex bounds."""

import hashlib
import random

import numpy as np
from pyspark.sql import types as T

from tessera.llm import centroids as C

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def whole(x):
    a, b = float(x).as_integer_ratio()
    return a * 64 // b


def brute(rows):
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))
    cents = [v for _, v in order[:16]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(3):
        of = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, k) in zip(kept, of) if k == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    inertia = [sum(d for d, k in of if k == j) for j in range(len(cents))]
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, fit(d), fit(inertia[j]), fit(sum(inertia)), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, of)), key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in C.clustered(spark, df).collect()), key=repr)


def test_equals_plain_integers(spark):
    r = random.Random(1)
    centre = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in centre[i % 5]]) for i in range(250)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[4][1])]  # equal vectors, repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [float("nan")]), (2004, [1.0] * 63 + [None]), (2005, [float("inf")] * 64), (2006, [0.0] * 64)]
    assert got(spark, rows) == brute(rows)


def test_very_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 10.0 ** (i % 30)) for _ in range(64)]) for i in range(60)] + [(100, [1e300] * 64), (101, [-1.7e308] * 64), (102, [2.0**40] * 64)]
    want = brute(rows)
    assert any(x[2] is None for x in want) and got(spark, rows) == want


def test_few_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(None, [1.0] * 64)]) == []


def test_clashing_columns(spark):
    r = random.Random(4)
    rows = [(i, [r.random() for _ in range(64)], i, 1.0, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster long, apex double, v string")
    assert sorted((tuple(x) for x in C.clustered(spark, df).collect()), key=repr) == brute([x[:2] for x in rows])


def test_bounds_hold_and_filter():
    r = np.random.default_rng(5)
    middle = r.integers(-60, 60, (6, 64))
    v = middle[r.integers(0, 6, 2000)] + r.integers(-9, 9, (2000, 64))
    cents = middle + r.integers(-3, 3, (6, 64))
    simplex = C.Simplex(v[:8].astype(float))
    a, c = simplex.apexes(v), simplex.apexes(cents)
    lower, upper = C.bounds(a, c)
    true = np.sqrt(((v[:, None] - cents) ** 2).sum(axis=2))
    assert (lower <= true + 1e-6).all() and (upper >= true - 1e-6).all()
    cluster, best, compared = C.nearest(v, a, cents, c)
    assert (cluster == (true**2).round().argmin(axis=1)).all() and (best == (true**2).round().min(axis=1)).all()
    assert compared < 0.5 * true.size  # most centroids are never compared


def test_limbs():
    for x in (0, 1, -1, 1 << 24, -(1 << 90) + 12345, 10**40):
        assert sum(v << (24 * i) for i, v in enumerate(C.limbs(x))) == x
