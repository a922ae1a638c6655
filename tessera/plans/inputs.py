"""Inputs of the non-corpus families, derived by Spark from the test tables.

Every derivation is an expression or aggregate over the given tables, so its
size grows with them.  ``SQL_*`` strings are the same derivations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash32, sql_hash32
from ..sources.corpus import read_table

N_LAYERS = 36          # layer = user_id mod N_LAYERS
STEP_BLOCK = 20        # events per step block; step = block * 10
BAD_NAME_EVERY = 20    # one run in ~20 gets a name without a layer number


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """events -> runs: one per user; name from the user's layer, a hash-chosen
    few corrupted; state from the first event type; created_at = first ts."""
    ev = read_table(spark, sf, "events")
    g = ev.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"),
                                  F.min("ts").alias("created_at"))
    name = (F.when(hash32("bad", F.col("user_id")) % BAD_NAME_EVERY == 0, F.lit("ckpt/baseline/stage2"))
            .otherwise(F.concat(F.lit("ckpt/run_"), (F.col("user_id") % N_LAYERS).cast("string"), F.lit("/stage2"))))
    state = (F.when(F.col("first_type") == "error", "crashed")
             .when(F.col("first_type") == "signup", "running").otherwise("finished"))
    return g.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                    name.alias("run_name"), state.alias("state"), "created_at")


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """events -> metric log: step = (event_id div 20) * 10, last loss per (run, step)."""
    ev = read_table(spark, sf, "events")
    blk = F.floor(F.col("event_id") / STEP_BLOCK)
    return (ev.groupBy("user_id", blk.alias("blk"))
            .agg(F.max_by("value", "event_id").alias("loss"))
            .select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                    (F.col("blk") * 10).cast("double").alias("step"), "loss"))


SQL_RUNS = f"""
runs AS (
  SELECT 'run-' || user_id AS run_id,
    CASE WHEN {sql_hash32('bad', 'user_id')} % {BAD_NAME_EVERY} = 0 THEN 'ckpt/baseline/stage2'
         ELSE 'ckpt/run_' || (user_id % {N_LAYERS}) || '/stage2' END AS run_name,
    CASE arg_min(event_type, event_id) WHEN 'error' THEN 'crashed' WHEN 'signup' THEN 'running'
         ELSE 'finished' END AS state,
    min(ts) AS created_at
  FROM events GROUP BY user_id),
metrics AS (
  SELECT 'run-' || user_id AS run_id, CAST((event_id // {STEP_BLOCK}) * 10 AS DOUBLE) AS step,
         arg_max(value, event_id) AS loss
  FROM events GROUP BY user_id, event_id // {STEP_BLOCK})"""
