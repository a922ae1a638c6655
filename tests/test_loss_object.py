"""S5 and S6 on single JSON objects, against json.loads, at several widths of byte ranges."""

import json
import math

import pytest

from tessera.sources import losslog

S, L = losslog.STEP_KEY, losslog.LOSS_KEY


def _rows(df):
    return sorted((r.run_name, str(r.steps), str(r.losses)) for r in df.collect())


def _want(objects):
    return sorted((k, str([None if x is None else float(x) for x in v.get(S) or []]), str([None if x is None else float(x) for x in v.get(L) or []]))
                  for o in objects for k, v in o.items())


OBJECTS = {
    "plain": {f"a/run_{k}/b": {S: [float(i) for i in range(k % 9)], L: [i / 7 for i in range(k % 11)]} for k in range(300)},
    "braces in names": {'x},': {S: [1.0], L: [2.0]}, '{"y": {': {S: [], L: [1e-9]}, "}": {S: [3.0], L: []}, 'q\\"},"': {S: [0.5], L: [1.5]}},
    "deeper": {"a": {"cfg": {"x": 1}, L: [1.0]}, "b": {S: [2.0], "cfg": {}}},
    "keys missing": {"a": {L: [1.0]}, "b": {S: [2.0]}, "c": {}, "": {S: [1.0], L: [math.nan, math.inf, 2.0, None]}},
    "no runs": {},
    "wide é世": {"世" * 50 + str(k): {S: [k], L: [k * 0.5, None]} for k in range(40)},
}


@pytest.mark.parametrize("width", [64, 1000, 1 << 27])
@pytest.mark.parametrize("indent", [None, 1])
def test_objects_equal_json_loads(spark, tmp_path, width, indent):
    for i, (name, o) in enumerate(OBJECTS.items()):
        (tmp_path / f"f {i}+%[1].json").write_text(json.dumps(o, indent=indent, ensure_ascii=i % 2 == 0) + "\n" * (i % 3), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    try:
        df = losslog.read_loss_log(spark, str(tmp_path), lines=False)
        assert _rows(df) == _want(OBJECTS.values())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_object_is_read_by_several_tasks(spark, tmp_path):
    o = OBJECTS["plain"]
    packed = spark.createDataFrame([(k, v[S], v[L]) for k, v in o.items()], "run_name string, steps array<double>, losses array<double>")
    losslog.write_loss_log(packed.repartition(5), f"{tmp_path}/log", single_object=True)
    files = list((tmp_path / "log").glob("*.txt"))
    assert len(files) == 1 and json.loads(files[0].read_text()) == o
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert losslog._of_another_shape(losslog._pieces(spark, f"{tmp_path}/log")).count() == 0
        df = losslog.read_loss_log(spark, f"{tmp_path}/log", lines=False)
        assert df.rdd.getNumPartitions() >= 5 and _rows(df) == _want([o])
        holders = {r[0] for r in df.selectExpr("spark_partition_id()").collect()}
        assert len(holders) >= 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    losslog.write_loss_log(packed.limit(0), f"{tmp_path}/none", single_object=True)
    assert _rows(losslog.read_loss_log(spark, f"{tmp_path}/none", lines=False)) == []


GOOD = json.dumps({"a": {S: [1.0], L: [2.0]}, "b": {S: [3.0], L: [4.0]}})


@pytest.mark.parametrize("text", [
    GOOD[:-1], GOOD + "}", GOOD.replace("}, ", "} "), GOOD.replace("}, ", "}}, "), GOOD + "junk", GOOD.replace("[1.0]", "[1.0"), "," + GOOD[1:],
    GOOD.replace("}, ", "},, "), "[1]", GOOD + "\n" + GOOD, GOOD[:-1] + "\n",
])
def test_malformed_objects_fail(spark, tmp_path, text):
    (tmp_path / "log.json").write_text(text)
    with pytest.raises(Exception):
        losslog.read_loss_log(spark, str(tmp_path), lines=False).collect()
