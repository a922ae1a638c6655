from pyspark.sql import functions as F

from tessera.operators import metrics as D


def test_kl_nonnegative_and_zero_on_equal(spark):
    df = spark.createDataFrame([([0.1, 2.0, -1.0], [0.1, 2.0, -1.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 3.0])],
                               "teacher array<double>, student array<double>")
    kl = [r[0] for r in df.select(D.kl_row(F.col("teacher"), F.col("student"))).collect()]
    assert abs(kl[0]) < 1e-12 and kl[1] > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["chunk_id", "input_ids"]
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
