"""Q1, Q2: streaming queries over files derived from the test tables; their
final outputs equal the batch operators (R8; H6 + H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chat import PRESETS
from ..session import scratch_path
from ..streaming import chat_state, live_ranking, unordered_chat
from . import chat as Hp
from . import losslog as Rp
from .registry import register

N_FILES = 4


@register("q1_live_ranking", sql="WITH " + Rp.SQL_CHAIN + " SELECT step, layer, loss, rank FROM ranked")
def q1_live_ranking(spark, sf):
    root = scratch_path(spark, "q1")
    pts = Rp._points(spark, sf).select("run_name", "layer", "step", "loss", F.lit(2).cast("long").alias("seq"))
    # some points are reported twice; the first report has another loss. Files hold some runs each,
    # so the points of a step come in several files, and a correction before or after what it corrects
    first = pts.filter(F.xxhash64("run_name", "step") % 3 == 0).withColumn("loss", F.col("loss") + 1).withColumn("seq", F.lit(1).cast("long"))
    pts.union(first).repartition(N_FILES, F.xxhash64("run_name", "seq")).write.parquet(f"{root}/source")
    q = live_ranking.start(spark, f"{root}/source", f"{root}/out", f"{root}/checkpoint", max_files_per_trigger=1)
    q.awaitTermination()
    return live_ranking.current_rankings(spark, f"{root}/out").select("step", "layer", "loss", "rank")


SQL_SESSIONS = "WITH " + Hp.SQL_CMDS + f""",
j AS (SELECT *, CASE WHEN kind = 'switch' AND len(parts) = 2 AND parts[2] IN ('1', '2', '3') THEN CAST(parts[2] AS INTEGER) END AS jump FROM seg),
c AS (SELECT *, CASE WHEN kind = 'switch' AND jump IS NULL THEN 1 ELSE 0 END AS bare FROM j),
c2 AS (SELECT *, sum(bare) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM c),
c3 AS (SELECT *, last_value(jump IGNORE NULLS) OVER w AS lastj,
                 last_value(CASE WHEN jump IS NOT NULL THEN cum END IGNORE NULLS) OVER w AS cum_at_j
       FROM c2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, kind, segment, CAST(((coalesce(lastj, 3) - 1 + cum - coalesce(cum_at_j, 0)) % 3) + 1 AS INTEGER) AS stage,
  nullif(last_value(CASE WHEN kind = 'mode' AND len(parts) >= 2 AND lower(parts[2]) IN ({", ".join("'" + p[0] + "'" for p in PRESETS)}, 'auto') THEN lower(parts[2]) END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'auto') AS locked
FROM c3"""


@register("q2_chat_session_state", sql=SQL_SESSIONS)
def q2_chat_session_state(spark, sf):
    root = scratch_path(spark, "q2")
    turns = Hp.with_commands(spark, sf)
    # a live chat delivers turns in order: one file per turn range, written in order
    mx = turns.agg(F.max("turn")).first()[0] or 0
    step = max(1, (mx + N_FILES) // N_FILES)
    for i, lo in enumerate(range(0, mx + 1, step)):
        part = turns.filter((F.col("turn") >= lo) & (F.col("turn") < lo + step))
        part.repartition(N_FILES, "conv_id").write.parquet(f"{root}/source/part{i:05d}")
    q = chat_state.start(spark, f"{root}/source/*", f"{root}/out", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("conv_id", "turn", "kind", "segment", "stage", "locked")


@register("q2_unordered_sessions", sql=SQL_SESSIONS)
def q2_unordered_sessions(spark, sf):
    """The same sessions from turns dealt to files by hash, so that those of a conversation come in any order."""
    root = scratch_path(spark, "q2-unordered")
    Hp.with_commands(spark, sf).repartition(N_FILES, F.xxhash64("conv_id", "turn")).write.parquet(f"{root}/source")
    unordered_chat.start(spark, f"{root}/source", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return unordered_chat.current_turns(spark.read.parquet(f"{root}/out"))
