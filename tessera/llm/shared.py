"""Tables written to the cluster's shared folder, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder in ``spark.checkpoint.dir`` and read it back: later reads need no
    executor that took part in making it."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); component: the smallest node reachable.

    Alternating large and small stars: each round hangs the neighbours of a node on its smallest one.
    A round is two sums and two joins; a hub is a join key, never a group in memory.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(spark, edges, "edges")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(least.select("a", "m")).distinct().toDF("a", "b")
        edges = written(spark, small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen = now
