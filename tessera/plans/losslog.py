"""R1-R11 and S5/S6 on runs/metrics derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..session import scratch_path
from ..sources import losslog
from . import inputs
from .inputs import SQL_RUNS
from .registry import register

EVERY = 500       # history sampling (reference default)
CLEAN_EVERY = 10  # ranking step filter (reference default)
EXPECTED_LAYERS = 40
TOP_K = 9
UNIFORM = (4, 3, 9)  # stride, offset, k


def _packed(spark, sf):
    picked = R.pick_runs(inputs.runs(spark, sf))
    return R.pack_runs(picked, R.sample_history(inputs.metrics(spark, sf), EVERY))


def _points(spark, sf):
    """The sampled rows of the picked runs; packing them into arrays and out again changes nothing here."""
    rows = R.sample_history(inputs.metrics(spark, sf), EVERY).join(R.pick_runs(inputs.runs(spark, sf)).select("run_id", "run_name"), "run_id")
    return R.clean_points(R.parse_layer(rows).filter("parse_ok"), CLEAN_EVERY)


def _ranked(spark, sf):
    return R.rank_layers(_points(spark, sf))


def _csv(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


SQL_CHAIN = SQL_RUNS + f""",
picked AS (SELECT run_name, run_id FROM runs WHERE state = 'finished'
           QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY created_at DESC, run_id) = 1),
sampled AS (SELECT * FROM metrics WHERE step IS NOT NULL AND CAST(trunc(step) AS BIGINT) % {EVERY} = 0),
unpacked AS (SELECT p.run_name, CAST(row_number() OVER (PARTITION BY p.run_name ORDER BY s.step) - 1 AS INTEGER) AS run_pos,
                    s.step, s.loss
             FROM sampled s JOIN picked p USING (run_id)),
parsed AS (SELECT *, regexp_extract(string_split(run_name, '/')[-2], '([^_]*)$', 1) AS tail FROM unpacked),
layered AS (SELECT * EXCLUDE (tail), TRY_CAST(tail AS INTEGER) AS layer FROM parsed
            WHERE regexp_full_match(tail, '[+-]?[0-9]+') AND len(string_split(run_name, '/')) >= 2),
points AS (SELECT * FROM layered WHERE step % {CLEAN_EVERY} = 0 AND loss IS NOT NULL),
ranked AS (SELECT step, layer, loss, run_name,
                  CAST(row_number() OVER (PARTITION BY step ORDER BY loss, layer, run_name) AS INTEGER) AS rank FROM points),
final AS (SELECT layer, avg(rank) AS score FROM ranked GROUP BY layer),
final_ranked AS (SELECT layer, score, CAST(row_number() OVER (ORDER BY score, layer) AS INTEGER) AS final_rank FROM final)"""


@register("r1_pick_runs", sql="WITH " + SQL_CHAIN + " SELECT run_name, run_id FROM picked")
def r1_pick_runs(spark, sf):
    return R.pick_runs(inputs.runs(spark, sf)).select("run_name", "run_id")


@register("r2_sample_history", sql="WITH " + SQL_CHAIN + " SELECT run_id, step, loss FROM sampled")
def r2_sample_history(spark, sf):
    return R.sample_history(inputs.metrics(spark, sf), EVERY)


@register("r3_pack_runs", sql="WITH " + SQL_CHAIN + """
SELECT run_name, CAST(count(*) AS INTEGER) AS n_points,
       md5(string_agg(CAST(CAST(step AS BIGINT) AS VARCHAR), ',' ORDER BY step)) AS steps_md5,
       round(sum(loss), 6) AS loss_sum
FROM unpacked GROUP BY run_name""")
def r3_pack_runs(spark, sf):
    p = _packed(spark, sf)
    return p.select("run_name", F.size("steps").alias("n_points"),
                    F.md5(_csv(F.transform("steps", lambda s: s.cast("bigint")))).alias("steps_md5"),
                    F.round(F.aggregate("losses", F.lit(0.0), lambda a, x: a + x), 6).alias("loss_sum"))


@register("r4_run_status", sql="WITH " + SQL_CHAIN + f""",
expected AS (SELECT 'ckpt/run_' || i || '/stage2' AS run_name FROM range({EXPECTED_LAYERS}) t(i)),
stats AS (SELECT run_id, count(*) AS n_rows,
                 sum(CASE WHEN CAST(trunc(step) AS BIGINT) % {EVERY} = 0 THEN 1 ELSE 0 END) AS n_sampled
          FROM metrics WHERE step IS NOT NULL GROUP BY run_id)
SELECT e.run_name,
  CASE WHEN p.run_id IS NULL THEN 'not_found' WHEN coalesce(s.n_rows, 0) = 0 THEN 'empty'
       WHEN coalesce(s.n_sampled, 0) = 0 THEN 'no_sampled_points' ELSE 'ok' END AS status,
  CAST(coalesce(s.n_sampled, 0) AS BIGINT) AS n_sampled
FROM expected e LEFT JOIN picked p USING (run_name) LEFT JOIN stats s USING (run_id)""")
def r4_run_status(spark, sf):
    expected = spark.range(EXPECTED_LAYERS).select(
        F.concat(F.lit("ckpt/run_"), F.col("id").cast("string"), F.lit("/stage2")).alias("run_name"))
    picked = R.pick_runs(inputs.runs(spark, sf))
    return R.run_status(expected, picked, inputs.metrics(spark, sf), EVERY)


@register("r5_parse_layer", sql="WITH " + SQL_CHAIN + """,
p AS (SELECT run_id, run_name, string_split(run_name, '/') AS segs FROM runs),
q AS (SELECT *, regexp_extract(segs[-2], '([^_]*)$', 1) AS tail FROM p)
SELECT run_id, run_name,
  CASE WHEN len(segs) >= 2 AND regexp_full_match(tail, '[+-]?[0-9]+') THEN TRY_CAST(tail AS INTEGER) END AS layer,
  coalesce(len(segs) >= 2 AND regexp_full_match(tail, '[+-]?[0-9]+'), false) AS parse_ok
FROM q""")
def r5_parse_layer(spark, sf):
    return R.parse_layer(inputs.runs(spark, sf)).select("run_id", "run_name", "layer", "parse_ok")


@register("r6_unpack_runs", sql="WITH " + SQL_CHAIN + " SELECT run_name, run_pos, step, loss FROM unpacked")
def r6_unpack_runs(spark, sf):
    return R.unpack_runs(_packed(spark, sf)).select("run_name", "run_pos", "step", "loss")


@register("r7_clean_points", sql="WITH " + SQL_CHAIN + " SELECT run_name, layer, step, loss FROM points")
def r7_clean_points(spark, sf):
    return _points(spark, sf).select("run_name", "layer", "step", "loss")


@register("r8_rank_layers", sql="WITH " + SQL_CHAIN + " SELECT step, layer, loss, rank FROM ranked")
def r8_rank_layers(spark, sf):
    return _ranked(spark, sf)


@register("r8_ranking_arrays", sql="WITH " + SQL_CHAIN + """
SELECT step, string_agg(CAST(layer AS VARCHAR), ',' ORDER BY rank) AS ranking FROM ranked GROUP BY step""")
def r8_ranking_arrays(spark, sf):
    return R.ranking_arrays(_ranked(spark, sf)).select("step", _csv(F.col("ranking")).alias("ranking"))


@register("r9_consolidate", sql="WITH " + SQL_CHAIN + """
SELECT layer, round(score, 6) AS score, final_rank FROM final_ranked""")
def r9_consolidate(spark, sf):
    c = R.consolidate(_ranked(spark, sf), "mean_rank")
    return c.select("layer", F.round("score", 6).alias("score"), "final_rank")


@register("r9_consolidate_last", sql="WITH " + SQL_CHAIN + """,
l AS (SELECT layer, CAST(rank AS DOUBLE) AS score FROM ranked WHERE step = (SELECT max(step) FROM ranked))
SELECT layer, score, CAST(row_number() OVER (ORDER BY score, layer) AS INTEGER) AS final_rank FROM l""")
def r9_consolidate_last(spark, sf):
    return R.consolidate(_ranked(spark, sf), "last")


@register("r9_consolidate_mean_loss", sql="WITH " + SQL_CHAIN + """,
l AS (SELECT layer, avg(loss) AS score FROM ranked GROUP BY layer)
SELECT layer, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score, layer) AS INTEGER) AS final_rank FROM l""")
def r9_consolidate_mean_loss(spark, sf):
    return R.consolidate(_ranked(spark, sf), "mean_loss").withColumn("score", F.round("score", 6))


@register("r10_top_k_layers", sql="WITH " + SQL_CHAIN + f"""
SELECT {TOP_K} AS k, string_agg(CAST(layer AS VARCHAR), ',' ORDER BY final_rank) AS ranked,
       string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) AS keep_layers
FROM final_ranked WHERE final_rank <= {TOP_K}""")
def r10_top_k_layers(spark, sf):
    t = R.top_k_layers(R.consolidate(_ranked(spark, sf), "mean_rank"), TOP_K)
    return t.select("k", _csv(F.col("ranked")).alias("ranked"), _csv(F.col("keep_layers")).alias("keep_layers"))


@register("r11_uniform_layers", sql="WITH " + SQL_CHAIN + f""",
u AS (SELECT {UNIFORM[1]} + i * {UNIFORM[0]} AS layer FROM range({UNIFORM[2]}) t(i)),
top AS (SELECT layer FROM final_ranked WHERE final_rank <= {TOP_K})
SELECT {UNIFORM[0]} AS stride, {UNIFORM[1]} AS layer_offset,
       (SELECT string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) FROM u) AS uniform_layers,
       CAST((SELECT count(*) FROM u JOIN top USING (layer)) AS INTEGER) AS overlap""")
def r11_uniform_layers(spark, sf):
    stride, off, k = UNIFORM
    top = R.top_k_layers(R.consolidate(_ranked(spark, sf), "mean_rank"), TOP_K)
    u = R.uniform_layers(stride, off, k)
    return top.select(F.lit(stride).alias("stride"), F.lit(off).alias("layer_offset"),
                      _csv(u).alias("uniform_layers"),
                      F.size(F.array_intersect(u, F.col("keep_layers"))).alias("overlap"))


@register("s5_loss_log_scan", sql="WITH " + SQL_CHAIN + " SELECT run_name, run_pos, step, loss FROM unpacked")
def s5_loss_log_scan(spark, sf):
    """S6 as JSON Lines, then S5 back: equals R6."""
    path = losslog.write_loss_log(_packed(spark, sf), scratch_path(spark, "losslog"))
    return R.unpack_runs(losslog.read_loss_log(spark, path)).select("run_name", "run_pos", "step", "loss")


@register("s5_object_scan", sql="WITH " + SQL_CHAIN + " SELECT run_name, run_pos, step, loss FROM unpacked")
def s5_object_scan(spark, sf):
    """S6 as one JSON object, read by the byte ranges of its file: equals R6."""
    path = losslog.write_loss_log(_packed(spark, sf), scratch_path(spark, "losslog-object"), single_object=True)
    return R.unpack_runs(losslog.read_loss_log(spark, path, lines=False)).select("run_name", "run_pos", "step", "loss")


@register("s6_loss_log_sink", sql="WITH " + SQL_CHAIN + """
SELECT run_name, CAST(count(*) AS INTEGER) AS n_points,
       md5(string_agg(CAST(CAST(step AS BIGINT) AS VARCHAR), ',' ORDER BY step)) AS steps_md5, round(sum(loss), 6) AS loss_sum
FROM unpacked GROUP BY run_name""")
def s6_loss_log_sink(spark, sf):
    """What was written, content and all: read back with S5."""
    path = losslog.write_loss_log(_packed(spark, sf), scratch_path(spark, "losslog-lines"))
    back = losslog.read_loss_log(spark, path)
    return back.select("run_name", F.size("steps").alias("n_points"),
                       F.md5(_csv(F.transform("steps", lambda s: s.cast("bigint")))).alias("steps_md5"),
                       F.round(F.aggregate("losses", F.lit(0.0), lambda a, x: a + x), 6).alias("loss_sum"))
