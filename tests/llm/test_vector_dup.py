"""Near-duplicate vectors against all pairs, and the edge cases."""

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import vector_dup as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def brute(rows, cosine=0.95):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scaled = [v / np.abs(v).max() for _, v in ok]
    unit = [v / np.sqrt((v * v).sum()) for v in scaled]
    parent = {i: i for i, _ in ok}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(ok)
    by_size = {}
    for k, (_, v) in enumerate(ok):
        by_size.setdefault(len(v), []).append(k)
    for some in by_size.values():
        m = np.array([unit[k] for k in some])
        for a, b in np.argwhere(m @ m.T >= cosine):
            if a != b:
                links[some[a]] += 1
                x, y = root(ok[some[a]][0]), root(ok[some[b]][0])
                parent[max(x, y)] = min(x, y)
    out = [(i, links[k], root(i), root(i) == i) for k, (i, _) in enumerate(ok)]
    out += [(i, 0, i, True) for i, v in rows if not (i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in V.vector_duplicates(spark, df, **options).collect()), key=repr)


def invented(seed, n, dims, copies, noise=0.02):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dims))
    out = [list(map(float, x)) for x in base]
    for k in range(copies):
        out.append([float(x) for x in base[k % 9] * 3 + r.standard_normal(dims) * noise * 3])
    return [(i, v) for i, v in enumerate(out)]


def test_exact_reach_equals_all_pairs(spark):
    rows = invented(1, 900, 24, 300, 0.15) + [(5000 + i, [1.0] * 24) for i in range(40)]
    assert got(spark, rows, sigmas=None, list_rows=40) == brute(rows)


def test_default_reach(spark):
    """Copies with as much noise as a link can have: recall of links by the default reach, none below the threshold."""
    r = np.random.default_rng(2)
    base = r.standard_normal((300, 64))
    rows = [(i, [float(x) for x in base[i % 300] + (i >= 300) * r.standard_normal(64) * 0.22]) for i in range(2400)]
    have, want = sum(x[1] for x in got(spark, rows, list_rows=20)), sum(x[1] for x in brute(rows))
    assert want > 2000 and 0.98 * want <= have <= want


def test_long_lists_are_dealt_to_units(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 32)
    monkeypatch.setattr(V, "VISITORS", 100)
    rows = invented(3, 200, 16, 500)
    assert got(spark, rows, list_rows=2000) == brute(rows)


@pytest.mark.parametrize("dims", [1, 3])
def test_few_components(spark, dims):
    rows = invented(dims, 60, dims, 30)
    assert got(spark, rows, list_rows=9) == brute(rows)


def test_edge_cases(spark):
    one = [0.5, 0.25, -1.0]
    rows = [(1, one), (2, [x * 2 for x in one]), (3, [x * 1e300 for x in one]), (4, [x * 1e-300 for x in one]), (5, [-x for x in one]), (6, None), (7, []), (8, [0.0, 0.0, 0.0]),
            (9, [1.0, None, 2.0]), (10, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0]), (12, one + [0.0]), (None, one), (13, one), (13, one), (14, [0.0, 1.0, 0.0]), (13, [0.0, 1.0, 0.01])]
    want = brute(rows)
    assert (14, 1, 1, False) in want  # by way of the id 13
    assert got(spark, rows) == want
    assert got(spark, []) == []


def test_clashing_columns(spark):
    rows = [(i, [float(i % 3), 1.0], i, "a", 2) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, h string, n int")
    assert sorted((tuple(r) for r in V.vector_duplicates(spark, df).collect()), key=repr) == brute([r[:2] for r in rows])
