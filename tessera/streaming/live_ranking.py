"""Q1: per-step layer ranking over an append-only metric stream.

``readStream`` of metric files -> ``foreachBatch``. Points and rankings are two state tables (``state_table``), by blocks of
``STEP_BLOCK`` steps. A batch adds its points (per run, layer and step the one with the highest sequence number wins), the steps
it touched are ranked anew from the points of their blocks, and only rankings that differ from the stored ones are added: they are
also the batch's output, under ``changes/epoch=``. A batch that is run again finds its epoch in the tables and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import rank_layers
from ..session import written
from .state_table import StateTable

POINT_SCHEMA = "run_name string, layer int, step double, loss double, seq long"
STEP_BLOCK = 5000


def tables(spark: SparkSession, out_dir: str) -> tuple[StateTable, StateTable]:
    """Points and rankings. A step never loses a point, so (step, rank) names a row of its ranking for good."""
    points = StateTable(spark, f"{out_dir}/points", f"{POINT_SCHEMA}, block long", ["block", "run_name", "layer", "step"], "block", "seq")
    ranks = StateTable(spark, f"{out_dir}/rankings", "step double, rank int, layer int, loss double, block long", ["block", "step", "rank"], "block")
    return points, ranks


def update(batch: DataFrame, epoch_id: int, out_dir: str) -> None:
    """One batch of points into the tables; the two commits may be apart, as each table knows its own epoch."""
    session = batch.sparkSession
    points, ranks = tables(session, out_dir)
    if ranks.epoch() >= epoch_id:
        return
    new = written(session, batch.withColumn("block", F.floor(F.col("step") / STEP_BLOCK).cast("long")), "batch")
    touched = [r.block for r in new.select("block").distinct().collect()]  # of one batch
    points.merge(new, epoch_id)
    rows = points.read(touched).join(new.select("step").distinct(), "step", "left_semi")
    ranked = rank_layers(rows).withColumn("block", F.floor(F.col("step") / STEP_BLOCK).cast("long"))
    known = ranks.read(touched).select(*[F.col(c).alias(f"_{c}") for c in ("step", "rank", "layer", "loss")])
    same = (F.col("step") == F.col("_step")) & (F.col("rank") == F.col("_rank")) & F.col("layer").eqNullSafe(F.col("_layer")) & F.col("loss").eqNullSafe(F.col("_loss"))
    changed = written(session, ranked.join(known, same, "left_anti"), "changed")
    changed.write.mode("overwrite").parquet(f"{out_dir}/changes/epoch={epoch_id}")
    ranks.merge(changed, epoch_id)


def start(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, available_now: bool = True,
          max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(POINT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    def merge(batch: DataFrame, epoch_id: int) -> None:
        update(batch, epoch_id, out_dir)

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current_rankings(spark: SparkSession, out_dir: str) -> DataFrame:
    """Layer rankings of every step seen so far."""
    return tables(spark, out_dir)[1].read().select("step", "layer", "loss", "rank")
