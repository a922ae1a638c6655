"""Training-log analytics -> per-step layer ranking -> keep-layers.

Inputs: ``runs (run_id, run_name, state, created_at)`` and
``metrics (run_id, step DOUBLE, loss DOUBLE)``.  Every grouping is a
partial aggregate or a window over one step (bounded by the number of runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick_runs(runs: DataFrame, state: str = "finished") -> DataFrame:
    """Per display name, the newest run in ``state`` (ties: smallest run_id).

    ``min_by`` over a struct key is a partial aggregate: a name shared by a
    third of all runs still combines map-side.
    """
    key = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), F.col("run_id").alias("id"))
    return (runs.filter(F.col("state") == state)
            .groupBy("run_name")
            .agg(F.min_by(F.struct("run_id", "created_at"), key).alias("r"))
            .select("run_name", "r.run_id", "r.created_at"))


def sample_history(metrics: DataFrame, every: int = 500) -> DataFrame:
    """R2: drop null steps; keep steps whose integer part is a multiple of ``every``."""
    return metrics.filter(F.col("step").isNotNull() & (F.col("step").cast("bigint") % every == 0))


def pack_runs(picked: DataFrame, sampled: DataFrame) -> DataFrame:
    """Per run, parallel step/loss arrays in step order; runs without rows
    are omitted.  Array length is bounded by max_steps / every."""
    j = sampled.join(picked.select("run_id", "run_name"), "run_id")
    return (j.groupBy("run_name")
            .agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("_p"))
            .select("run_name", F.col("_p.step").alias("steps"), F.col("_p.loss").alias("losses")))


def run_status(expected: DataFrame, picked: DataFrame, metrics: DataFrame, every: int = 500) -> DataFrame:
    """For every expected run name: not_found / empty / no_sampled_points / ok."""
    stats = (metrics.filter(F.col("step").isNotNull())
             .groupBy("run_id")
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum((F.col("step").cast("bigint") % every == 0).cast("int")).alias("n_sampled")))
    j = expected.join(picked, "run_name", "left").join(stats, "run_id", "left")
    status = (F.when(F.col("run_id").isNull(), "not_found")
              .when(F.coalesce("n_rows", F.lit(0)) == 0, "empty")
              .when(F.coalesce("n_sampled", F.lit(0)) == 0, "no_sampled_points")
              .otherwise("ok"))
    return j.select("run_name", status.alias("status"),
                    F.coalesce("n_sampled", F.lit(0)).cast("long").alias("n_sampled"))


def parse_layer(df: DataFrame, name_col: str = "run_name") -> DataFrame:
    """Layer index = text after the last ``_`` of the second-to-last path
    segment; adds ``layer`` (null when unparsable) and ``parse_ok``.
    Use ``.filter('parse_ok')`` for good rows and ``~parse_ok`` for the
    quarantine table."""
    seg = F.try_element_at(F.split(F.col(name_col), "/"), F.lit(-2))
    tail = F.regexp_extract(seg, r"([^_]*)$", 1)
    ok = F.coalesce(tail.rlike(r"^[+-]?[0-9]+$"), F.lit(False)) & (F.size(F.split(F.col(name_col), "/")) >= 2)
    return df.withColumn("layer", F.when(ok, tail.try_cast("int"))).withColumn("parse_ok", ok & F.col("layer").isNotNull())


def unpack_runs(packed: DataFrame) -> DataFrame:
    """Zip steps with losses, truncated to the shorter array."""
    n = F.least(F.size("steps"), F.size("losses"))
    z = F.arrays_zip(F.slice("steps", 1, n).alias("step"), F.slice("losses", 1, n).alias("loss"))
    rest = [c for c in packed.columns if c not in ("steps", "losses")]
    return packed.select(*rest, F.posexplode(z).alias("run_pos", "p")).select(*rest, "run_pos", "p.step", "p.loss")


def clean_points(points: DataFrame, every: int = 10) -> DataFrame:
    """Steps multiple of ``every`` with a non-null loss (NaN kept)."""
    return points.filter((F.col("step") % every == 0) & F.col("loss").isNotNull())


def rank_layers(points: DataFrame) -> DataFrame:
    """R8 long form: per step, rank 1 = lowest loss; ties keep run order
    (layer, then run name).  NaN losses sort last."""
    w = Window.partitionBy("step").orderBy("loss", "layer", "run_name")
    return points.select("step", "layer", "loss", F.row_number().over(w).alias("rank"))


def ranking_arrays(ranked: DataFrame) -> DataFrame:
    """R8 array form: ``step, ranking ARRAY<INT>`` best to worst."""
    return (ranked.groupBy("step")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "layer"))).alias("_r"))
            .select("step", F.col("_r.layer").alias("ranking")))


def consolidate(ranked: DataFrame, how: str = "mean_rank") -> DataFrame:
    """One ranking from many steps.

    ``last``: ranking at the latest step; ``mean_rank``/``mean_loss``: average
    per layer, then rank (ties by layer).  Output ``layer, score, final_rank``.
    """
    if how == "last":
        last = ranked.agg(F.max("step").alias("step"))
        base = ranked.join(F.broadcast(last), "step").select("layer", F.col("rank").cast("double").alias("score"))
    elif how == "mean_rank":
        base = ranked.groupBy("layer").agg(F.avg("rank").alias("score"))
    elif how == "mean_loss":
        base = ranked.groupBy("layer").agg(F.avg("loss").alias("score"))
    else:
        raise ValueError(f"unknown consolidation {how!r}")
    # one row per layer: the window runs over at most model-depth rows
    return base.select("layer", "score", F.row_number().over(Window.orderBy("score", "layer")).alias("final_rank"))


def top_k_layers(final: DataFrame, k: int) -> DataFrame:
    """First ``k`` layers, both in rank order and sorted."""
    top = final.filter(F.col("final_rank") <= k)
    return top.agg(F.array_sort(F.collect_list(F.struct("final_rank", "layer"))).alias("_t")).select(
        F.lit(k).alias("k"), F.col("_t.layer").alias("ranked"), F.sort_array(F.col("_t.layer")).alias("keep_layers"))


def uniform_layers(stride: int, offset: int, k: int) -> F.Column:
    """Evenly spaced layers ``offset + i*stride`` for i < k."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.lit(offset) + i * F.lit(stride))
