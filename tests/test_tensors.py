from tessera.operators import tensors as W


def _t(spark, rows):
    return spark.createDataFrame(rows, "name string, row_id long, values array<float>")


def test_mask_all_equal_and_small_k(spark):
    t = _t(spark, [("a", 0, [1.0, 1.0, 1.0, 1.0]), ("b", 0, [0.5, -2.0, 3.0])])
    thr = {r.name: (r.k, r.threshold) for r in W.magnitude_threshold(t, 0.3).collect()}
    assert thr["a"] == (1, 1.0)      # ties at the threshold are pruned too
    assert thr["b"] == (0, None)     # floor(3*0.3)=0 keeps all
    m = {r.name: r.mask for r in W.apply_mask(t, W.magnitude_threshold(t, 0.3)).collect()}
    assert m["a"] == [False] * 4 and m["b"] == [True] * 3


def test_mask_exact_kth(spark):
    import random

    random.seed(3)
    vals = [random.uniform(-1, 1) for _ in range(3000)]
    t = _t(spark, [("w", i, vals[i * 30:(i + 1) * 30]) for i in range(100)])
    import numpy as np

    f32 = np.abs(np.array(vals, dtype=np.float32).astype(np.float64))
    k = int(3000 * 0.37)
    r = W.magnitude_threshold(t, 0.37).first()
    assert r.k == k and r.threshold == sorted(f32)[k - 1]


def test_sparsity_zero(spark):
    t = _t(spark, [("a", 0, [1.0, 2.0])])
    assert W.magnitude_threshold(t, 0.0).first().threshold is None


def test_clean_keys(spark):
    df = spark.createDataFrame([("module.x",), ("_forward_module.x",), ("a.student_attn.b",), ("a.teacher_attn.b",),
                                ("m.module.y",)], "key string")
    assert sorted(r.key for r in W.clean_keys(df).collect()) == ["a.b", "m.module.y", "x", "x"]
