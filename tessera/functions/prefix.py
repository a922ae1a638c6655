"""Global running sums without a single-partition window.

A running total over a huge table is computed in two levels: the narrow rows (order columns and the
value, nothing else) are range-partitioned by their order, which gives each range a number that grows
with the order; per-range totals are summed (partial aggregation, one row a range), a running sum over the
*ranges* gives each its base, and a window inside each range finishes the job. The ranged rows are written
to the shared folder, so both readings see the same ranges whatever happens to an executor; so are the rows
before that, so their number, the sample for the ranges and the exchange take one evaluation of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

ROWS_PER_RANGE = 200_000


def ranged(df: DataFrame, order: list, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with ``_range``: the number of the range of ``order`` that a row lies in.

    The number of ranges follows the row count, so a range keeps its size at any scale."""
    spark = df.sparkSession
    narrow = scratch_path(spark, "narrow")
    df.write.parquet(narrow)  # ``df`` is evaluated here and nowhere else: count, sample and exchange read these rows
    rows = spark.read.schema(df.schema).parquet(narrow)
    n = rows.count()
    parts = max(1, math.ceil(n / rows_per_range), min(n, spark.sparkContext.defaultParallelism))
    path = scratch_path(spark, "ranges")
    rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def running_total(df: DataFrame, order: list | str, value: str | None, out: str, exclusive: bool = True,
                  rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``out`` = sum of ``value`` over rows before (exclusive) or up to this one in ``order``.

    ``order`` (names or sort expressions) must order the rows uniquely; ``value`` None counts rows.
    Pass only the columns needed: all of ``df`` goes through the sort."""
    order = [order] if isinstance(order, str) else list(order)
    rows = ranged(df, order, rows_per_range)
    one = F.lit(1).cast("long") if value is None else F.col(value)
    totals = rows.groupBy("_range").agg(F.sum(one).alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_base") + F.sum(one).over(inside)
    return rows.join(base, "_range").withColumn(out, total - one if exclusive else total).drop("_base", "_range")


def dense_index(df: DataFrame, order: list | str, out: str) -> DataFrame:
    """0-based dense position of each row in ``order``."""
    return running_total(df, order, None, out)
