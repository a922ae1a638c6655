import datetime as dt
import math

from tessera.operators import ranking as R


def test_unpack_truncates_to_shorter(spark):
    df = spark.createDataFrame([("a/run_1/s", [10.0, 20.0, 30.0], [1.0, 2.0])],
                               "run_name string, steps array<double>, losses array<double>")
    assert [(r.step, r.loss) for r in R.unpack_runs(df).collect()] == [(10.0, 1.0), (20.0, 2.0)]


def test_clean_keeps_nan_drops_null(spark):
    df = spark.createDataFrame([("r", 1, 10.0, None), ("r", 1, 20.0, float("nan")), ("r", 1, 25.0, 1.0)],
                               "run_name string, layer int, step double, loss double")
    out = R.clean_points(df).collect()
    assert len(out) == 1 and math.isnan(out[0].loss)


def test_rank_ties_by_layer_and_nan_last(spark):
    df = spark.createDataFrame([("r3", 3, 10.0, 1.0), ("r1", 1, 10.0, 1.0), ("r2", 2, 10.0, float("nan")),
                                ("r0", 0, 10.0, 0.5)], "run_name string, layer int, step double, loss double")
    got = [r.layer for r in R.rank_layers(df).orderBy("rank").collect()]
    assert got == [0, 1, 3, 2]


def test_parse_layer_bad_names(spark):
    df = spark.createDataFrame([("ckpt/run_12/stage2",), ("ckpt/baseline/stage2",), ("single",), ("x/run_1_0/y",)],
                               "run_name string")
    got = {r.run_name: (r.layer, r.parse_ok) for r in R.parse_layer(df).collect()}
    assert got["ckpt/run_12/stage2"] == (12, True)
    assert got["ckpt/baseline/stage2"][1] is False
    assert got["single"][1] is False
    assert got["x/run_1_0/y"] == (0, True)


def test_pick_runs_newest_finished(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([("b", "n", "finished", t), ("a", "n", "finished", t),
                                  ("c", "n", "crashed", t + dt.timedelta(1)), ("d", "n", "finished", t - dt.timedelta(1))],
                                 "run_id string, run_name string, state string, created_at timestamp")
    assert R.pick_runs(runs).first().run_id == "a"
