import numpy as np
import pytest

from tessera.operators import tensors as W


@pytest.mark.parametrize("kind", ["float", "double"])
def test_thresholds_with_ties_zeros_outliers_and_nan(spark, kind):
    r = np.random.default_rng(6)
    tensors = {"plain": r.standard_normal((30, 40)), "ties": r.integers(-3, 4, (20, 25)) * 0.5, "zeros": np.zeros((7, 9)), "outlier": np.concatenate((r.standard_normal(99) * 1e-30, [3e38])).reshape(10, 10),
               "nan": np.where(r.random((8, 8)) < 0.2, np.nan, r.standard_normal((8, 8))), "tiny": np.array([[1.0, -2.0]]), "signs": np.array([[-0.0, 0.0, -5.0, 5.0, float("inf")]])}
    rows = [(n, i, [float(np.float32(x)) for x in row]) for n, t in tensors.items() for i, row in enumerate(t)]
    df = spark.createDataFrame(rows, f"name string, row_id long, values array<{kind}>").repartition(5)
    for sparsity in (0.0, 0.3, 0.5, 0.95, 1.0):
        thr = W.magnitude_threshold(df, sparsity)
        got = {x.name: (x.n, x.k, x.threshold) for x in thr.collect()}
        for n, t in tensors.items():
            a = np.sort(np.abs(t.astype(np.float32)).astype(np.float64).ravel())
            k = int(np.floor(a.size * sparsity))
            assert got[n][:2] == (a.size, k)
            assert (got[n][2] is None) if k == 0 else np.array_equal(got[n][2], a[k - 1], equal_nan=True), (n, sparsity)


def test_no_element_becomes_a_row(spark):
    df = spark.createDataFrame([("a", 0, [1.0, None, 2.0]), ("b", 0, []), (None, 1, [3.0])], "name string, row_id long, values array<float>")
    thr = W.magnitude_threshold(df, 0.5)
    assert "Generate" not in thr._jdf.queryExecution().executedPlan().toString()
    assert {r.name: (r.n, r.k, r.threshold) for r in thr.collect()}["a"] == (2, 1, 1.0)
    assert W.magnitude_threshold(df.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_audit_fetches_only_rows_that_differ(spark, monkeypatch, few):
    monkeypatch.setattr(W, "FEW_ROWS", few)
    nan, inf = float("nan"), float("inf")
    src = [("model.embed_tokens.w", i, [float(i), 1.0]) for i in range(6)] + [("same", 0, [1.0, 2.0]), ("odd", 0, [nan, 1.0]), ("odd", 1, [inf]), ("empty", 0, []), ("gone", 0, [1.0])]
    tgt = [("model.embeddings.w", i, [float(i) + (0.5 if i == 3 else 0), 1.0]) for i in range(5)] + [("same", 0, [1.0, 2.0]), ("odd", 0, [nan, 1.0]), ("odd", 1, [inf]), ("empty", 0, []), ("more", 0, [1.0])]
    schema = "name string, row_id long, values array<float>"
    a = {r.name: r for r in W.parity_audit(spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema), *W.TOLERANCES["float32"]).collect()}
    assert (a["model.embeddings.w"].max_abs_diff, a["model.embeddings.w"].n_mismatch, a["model.embeddings.w"].missing_rows) == (0.5, 1, 1)
    assert (a["same"].max_abs_diff, a["same"].n_mismatch) == (0.0, 0) and a["empty"].max_abs_diff is None and a["empty"].n_mismatch == 0
    assert np.isnan(a["odd"].max_abs_diff) and a["odd"].n_mismatch == 1  # the NaN; infinities agree
    assert (a["gone"].missing_rows, a["gone"].max_abs_diff, a["more"].extra_rows) == (1, None, 1)
