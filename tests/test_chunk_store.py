"""Random access to stored chunks: what is read, what is scanned, and what a failed append leaves."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.chunk_store import ChunkStore


def _chunks(spark, lo, hi, order=1):
    return spark.range(lo, hi).orderBy(F.col("id") * order).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("int"), F.lit(7)).alias("input_ids"))


def _ids(df):
    return sorted(r.chunk_id for r in df.collect())


def test_ranges_over_appends(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), rows_per_file=10)
    for lo, hi in ((0, 33), (33, 34), (34, 95)):
        store.append(_chunks(spark, lo, hi, -1).repartition(5))
    for lo, hi in ((0, 95), (0, 1), (29, 41), (33, 34), (90, 200), (50, 50), (95, 99)):
        rows = store.read(lo, hi).collect()
        assert sorted(r.chunk_id for r in rows) == list(range(lo, min(hi, 95)))
        assert all(r.input_ids == [r.chunk_id, 7] for r in rows)
    assert _ids(store.read(version=1)) == list(range(33))


def test_a_range_names_only_its_files(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), rows_per_file=10)
    store.append(_chunks(spark, 0, 100).repartition(7))
    part = store.read(42, 58)
    assert len(part.inputFiles()) == 2 and len(store.read().inputFiles()) == 10
    assert "PushedFilters: [IsNotNull(chunk_id), GreaterThanOrEqual(chunk_id,42)" in part._jdf.queryExecution().toString()


@pytest.mark.parametrize("bad", ["gap", "repeat", "again", "null"])
def test_a_failed_append_leaves_the_store(spark, tmp_path, bad):
    store = ChunkStore(spark, str(tmp_path / "s"), rows_per_file=10)
    store.append(_chunks(spark, 0, 20))
    rows = {"gap": _chunks(spark, 21, 25), "repeat": _chunks(spark, 20, 22).union(_chunks(spark, 20, 22)), "again": _chunks(spark, 19, 22),
            "null": _chunks(spark, 20, 22).union(_chunks(spark, 22, 23).withColumn("chunk_id", F.lit(None).cast("long")))}[bad]
    with pytest.raises(ValueError, match="must go on from 20"):
        store.append(rows)
    assert _ids(store.read()) == list(range(20)) and store.manifests.latest()["version"] == 1


def test_a_torn_manifest_is_passed_over(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="empty"):
        store.read()
    assert store.append(_chunks(spark, 0, 0))["version"] == 0
    store.append(_chunks(spark, 0, 5))
    (tmp_path / "s" / "manifests" / "00000002.json").write_text('{"version": 2, "segm')
    assert _ids(store.read()) == list(range(5))
    assert store.append(_chunks(spark, 5, 9))["version"] == 3 and _ids(store.read()) == list(range(9))
    with pytest.raises(ValueError, match="own"):
        store.append(_chunks(spark, 9, 10).withColumn("file", F.lit(1)))
