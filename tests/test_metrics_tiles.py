import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as D


def _logits(seed, n, width, spread=30.0):
    r = np.random.default_rng(seed)
    return r.standard_normal((n, width)) * spread, r.standard_normal((n, width)) * spread


def _kl(t, s):
    lt = t - t.max(axis=1, keepdims=True)
    ls = s - s.max(axis=1, keepdims=True)
    lt, ls = lt - np.log(np.exp(lt).sum(axis=1, keepdims=True)), ls - np.log(np.exp(ls).sum(axis=1, keepdims=True))
    return (np.exp(lt) * (lt - ls)).sum(axis=1)


def test_long_form_equals_arrays_over_many_tasks(spark):
    t, s = _logits(1, 6, 700)
    rows = [(p, v, float(t[p, v]), float(s[p, v])) for p in range(6) for v in range(700)]
    for parts in (1, 13):
        df = spark.createDataFrame(rows, "pos long, vocab_id int, teacher double, student double").repartition(parts)
        kl = {r.pos: r.kl for r in D.kl_long(df).collect()}
        assert np.allclose([kl[p] for p in range(6)], _kl(t, s), rtol=1e-9)
        lse = {r.pos: r.lse for r in D.logsumexp_long(df, logit="teacher").collect()}
        m = t.max(axis=1)
        assert np.allclose([lse[p] for p in range(6)], m + np.log(np.exp(t - m[:, None]).sum(axis=1)), rtol=1e-12)


def test_one_long_position_is_summed_in_its_tasks(spark):
    df = spark.range(0, 200_000, 1, 16).select(F.lit(0).cast("long").alias("pos"), F.col("id").alias("vocab_id"), (F.col("id") % 97 - 400).cast("double").alias("logit"))
    out = D.logsumexp_long(df)
    x = np.arange(200_000) % 97 - 400.0
    assert abs(out.first().lse - (x.max() + np.log(np.exp(x - x.max()).sum()))) < 1e-9
    assert "partial_sum" in out._jdf.queryExecution().executedPlan().toString()


def test_extremes(spark):
    inf = float("inf")
    rows = [(1, 1e5, 1e5), (1, -1e5, 3.0), (2, -inf, -inf), (2, 0.5, 0.25), (2, None, None), (3, -inf, 1.0), (4, float("nan"), 1.0), (4, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pos long, teacher double, student double")
    lse = {r.pos: r.lse for r in D.logsumexp_long(df, logit="teacher").collect()}
    assert lse[1] == 1e5 and lse[2] == 0.5 and np.isnan(lse[4]) and (lse[3] is None or lse[3] == -inf)
    kl = {r.pos: r.kl for r in D.kl_long(df.where("pos < 3")).collect()}
    assert abs(kl[1]) < 1e-9 and abs(kl[2]) < 1e-12
    assert D.kl_long(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows,tile,width,groups", [(7, 5, 4, 1), (100, 1000, 100, 1), (3, 8, 5, 3)])
def test_tiled_product_equals_numpy(spark, block_rows, tile, width, groups):
    r = np.random.default_rng(4)
    xt, xs, wt, ws = r.standard_normal((23, 12)), r.standard_normal((23, 9)), r.standard_normal((31, 12)), r.standard_normal((31, 9))
    hidden = spark.createDataFrame([(10 * i, xt[i].tolist(), xs[i].tolist()) for i in range(23)], "pos long, teacher array<double>, student array<double>").repartition(3)
    weights = spark.createDataFrame([(i, wt[i].tolist(), ws[i].tolist()) for i in range(31)], "v long, teacher array<double>, student array<double>").repartition(4)
    kl = {x.pos: x.kl for x in D.projected_kl(hidden, weights, block_rows, tile, width, groups).collect()}
    assert np.allclose([kl[10 * i] for i in range(23)], _kl(xt @ wt.T, xs @ ws.T), rtol=1e-9)


def test_hidden_rows_move_once_however_many_weight_blocks(spark):
    hidden = spark.createDataFrame([(i, [0.5] * 8, [1.0] * 8) for i in range(50)], "pos long, teacher array<double>, student array<double>")
    weights = spark.createDataFrame([(i, [0.1 * i] * 8, [0.2] * 8) for i in range(40)], "v long, teacher array<double>, student array<double>")
    moved = {b: D.product_tiles(hidden, weights, b, 10, 8, 1).groupBy("side").count().collect() for b in (1, 5, 40)}
    assert all({r.side: r["count"] for r in rows} == {0: 50, 1: 200} for rows in moved.values())
