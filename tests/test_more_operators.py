"""W1, W2, W5, W8, D4, D7, R9, L1, L4, S5/S6 on hand-made rows."""

import math

import numpy as np
import pytest

from tessera.operators import batching, metrics, ranking, tensors
from tessera.sources import losslog


def _tensor(spark, rows):
    return spark.createDataFrame(rows, "name string, row_id long, values array<float>")


def test_threshold_is_exact_with_outliers_ties_and_zeros(spark):
    r = np.random.default_rng(0)
    cases = {"normal": r.standard_normal(400), "outlier": np.concatenate((r.standard_normal(399), [1e30])), "equal": np.ones(400), "zeros": np.concatenate((np.zeros(300), r.standard_normal(100))),
             "tiny": r.standard_normal(400) * 1e-30}
    rows = [(n, i, [float(x) for x in v[i * 40:(i + 1) * 40]]) for n, v in cases.items() for i in range(10)]
    for sparsity in (0.0, 0.001, 0.5, 0.73, 1.0):
        got = {t.name: (t.k, t.threshold) for t in tensors.magnitude_threshold(_tensor(spark, rows), sparsity).collect()}
        for n, v in cases.items():
            k = math.floor(400 * sparsity)
            want = float(np.sort(np.abs(v.astype(np.float32)).astype(np.float64))[k - 1]) if k else None
            assert got[n] == (k, want), (n, sparsity)


def test_merge_takes_all_attention_of_kept_layers_from_the_teacher(spark):
    t = _tensor(spark, [(n, 0, [1.0]) for n in ("model.layers.1.self_attn.q.w", "model.layers.1.attn_norm.w", "model.layers.2.self_attn.q.w", "model.layers.1.mlp.w", "other.layers.1.attn.w")])
    s = _tensor(spark, [(n, 0, [2.0]) for n in ("model.layers.1.self_attn.q.w", "model.layers.1.self_attn.g.w", "model.layers.2.self_attn.q.w", "other.layers.1.attn.w")])
    m = tensors.hybrid_merge(t, s, spark.createDataFrame([(1,)], "layer int"))
    assert {(r.name, r.source) for r in m.collect()} == {("model.layers.1.self_attn.q.w", "teacher"), ("model.layers.1.attn_norm.w", "teacher"),
                                                         ("model.layers.2.self_attn.q.w", "student"), ("other.layers.1.attn.w", "student")}
    assert [r.name for r in tensors.missing_keys(m, t).collect()] == ["model.layers.1.mlp.w"]


def test_groups_have_rates_for_what_is_trained(spark):
    t = _tensor(spark, [("a.attn_norm", 0, [1.0] * 3), ("b.mlp", 0, [1.0] * 5), ("embed", 0, [1.0] * 2000)])
    g = {r.group: r for r in tensors.parameter_groups(tensors.parameter_table(t, ["embed", "b.mlp"]), 0.1, 0.2).collect()}
    assert (g["attn"].n_params, g["attn"].learning_rate) == (3, 0.1)
    assert (g["other"].n_params, g["other"].n_trainable, g["other"].learning_rate, g["other"].n_params_text) == (2005, 0, None, "1.96Ki")


def test_projected_kl_with_two_matrices(spark):
    r = np.random.default_rng(1)
    xt, xs, wt, ws = r.standard_normal((50, 6)), r.standard_normal((50, 4)), r.standard_normal((23, 6)), r.standard_normal((23, 4))
    hidden = spark.createDataFrame([(i, xt[i].tolist(), xs[i].tolist()) for i in range(50)], "pos long, teacher array<double>, student array<double>")
    weights = spark.createDataFrame([(i, wt[i].tolist(), ws[i].tolist()) for i in range(23)], "v long, teacher array<double>, student array<double>")
    got = {x.pos: x.kl for x in metrics.projected_kl(hidden, weights, block_rows=5, block_positions=7).collect()}
    soft = lambda z: z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    lt, ls = soft(xt @ wt.T), soft(xs @ ws.T)
    assert np.allclose([got[i] for i in range(50)], (np.exp(lt) * (lt - ls)).sum(axis=1))


def test_cross_entropy_reads_the_next_token(spark):
    rows = [(0, 1, [0.0, 0.0, 1.0]), (1, 2, [0.0, 2.0, 0.0]), (2, 0, [0.0, 0.0, 0.0])]
    d = metrics.next_targets(spark.createDataFrame(rows, "pos long, token int, logits array<double>"))
    assert {(r.pos, r.target) for r in d.collect()} == {(0, 2), (1, 0)}
    want = [math.log(2 + math.e) - 1, math.log(2 + math.exp(2))]
    assert metrics.cross_entropy(d, "logits").first().ce_loss == pytest.approx(np.mean(want))


def test_consolidations(spark):
    rows = [(1.0, 0, 0.5, 2), (1.0, 1, 0.4, 1), (2.0, 0, 0.1, 1), (2.0, 1, 0.9, 2)]
    ranked = spark.createDataFrame(rows, "step double, layer int, loss double, rank int")
    order = lambda how: [r.layer for r in ranking.consolidate(ranked, how).orderBy("final_rank").collect()]
    assert order("last") == [0, 1] and order("mean_loss") == [0, 1] and order("mean_rank") == [0, 1]


def test_steps_fill_all_epochs_of_each_run(spark):
    ids = spark.createDataFrame([(i, 4) for i in range(10)], "chunk_id long, chunk_len int")
    plan = batching.budget_plan(spark.createDataFrame([("a", 100, None, 3, 1, 1, 4), ("b", None, 2, 4, 2, 2, 4), ("c", 4, 9, 1, 1, 1, 8)],
                                                      "run string, target_tokens long, max_steps long, batch_size int, micro_batch_size int, world_size int, seq_len int"))
    rows = batching.assign_steps(ids, plan, 3).collect()
    a = [r for r in rows if r.run == "a"]  # 8 steps of 3: two epochs and four chunks
    assert len(a) == 24 and {r.step for r in a} == set(range(8)) and {r.epoch for r in a} == {0, 1, 2}
    for e in (0, 1):
        assert sorted(r.chunk_id for r in a if r.epoch == e) == list(range(10))
    b = [r for r in rows if r.run == "b"]
    assert sorted((r.step, r.accum_slot, r.rank, r.lane) for r in b) == [(s, 0, k, m) for s in range(2) for k in range(2) for m in range(2)]
    assert not [r for r in rows if r.run == "c"]  # no chunks of its length


def test_epoch_order_is_a_permutation(spark):
    d = spark.createDataFrame([(i, [i]) for i in range(57)], "chunk_id long, input_ids array<int>")
    a, b = ({r.chunk_id: r.pos for r in batching.epoch_order(d, 1, e).collect()} for e in (0, 1))
    assert sorted(a.values()) == sorted(b.values()) == list(range(57)) and a != b


@pytest.mark.parametrize("single", [False, True])
def test_loss_log_round_trip(spark, tmp_path, single):
    rows = [("x/run_1/s", [1.0, 2.0], [0.5, None]), ("y", [], [])]
    packed = spark.createDataFrame(rows, "run_name string, steps array<double>, losses array<double>")
    path = losslog.write_loss_log(packed, f"{tmp_path}/log", single_object=single)
    assert sorted(tuple(r) for r in losslog.read_loss_log(spark, path, lines=not single).collect()) == sorted(rows)
