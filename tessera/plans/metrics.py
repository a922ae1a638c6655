"""D1-D7 on ``embeddings``: vector ``vec_id`` paired with ``(vec_id+1) mod count``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prefix
from ..operators import metrics as D
from ..sources.corpus import read_table
from .registry import register

W_LABEL = 0          # D7: rows with this label form the projection matrix
BLOCK_ROWS = 16      # D7: W rows per block
WIDTH, TILE, GROUPS = 24, 256, 2  # D7: columns of a slice, positions of a tile, tasks a tile


def pairs(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.count()
    t = e.select(F.col("vec_id").alias("pos"), F.col("label").alias("layer"), F.col("v").alias("teacher"))
    s = e.select(((F.col("vec_id") - 1 + n) % n).alias("pos"), F.col("v").alias("student"))
    return t.join(s, "pos")


SQL_PAIRS = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
pairs AS (SELECT t.vec_id AS pos, t.label AS layer, t.v AS teacher, s.v AS student
          FROM e t JOIN e s ON t.vec_id = (s.vec_id - 1 + (SELECT n FROM n)) % (SELECT n FROM n)),
lse AS (SELECT *, list_max(teacher) + ln(list_sum(list_transform(teacher, lambda x: exp(x - list_max(teacher))))) AS lse_t,
                  list_max(student) + ln(list_sum(list_transform(student, lambda x: exp(x - list_max(student))))) AS lse_s
        FROM pairs),
lp AS (SELECT *, list_transform(teacher, lambda x: x - lse_t) AS lp_t, list_transform(student, lambda x: x - lse_s) AS lp_s FROM lse),
kl AS (SELECT *, list_sum(list_transform(list_zip(lp_t, lp_s), lambda z: exp(z[1]) * (z[1] - z[2]))) AS kl,
                 sqrt(list_sum(list_transform(list_zip(teacher, student), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sqrt(len(teacher)) AS align
       FROM lp)"""


@register("d1_log_softmax", sql=SQL_PAIRS + """
SELECT pos, round(lse_t, 6) AS lse, round(list_sum(lp_t), 6) AS logp_sum,
       round(list_sum(list_transform(list_zip(lp_t, range(len(lp_t))), lambda z: z[1] * (z[2] + 1))), 4) AS logp_weighted FROM lp""")
def d1_log_softmax(spark, sf):
    """Every element counts, each with its place."""
    p = pairs(spark, sf).select("pos", F.round(D.logsumexp(F.col("teacher")), 6).alias("lse"), D.log_softmax(F.col("teacher")).alias("lp"))
    weighted = D._sum(F.transform("lp", lambda x, i: x * (i + 1)))
    return p.select("pos", "lse", F.round(D._sum(F.col("lp")), 6).alias("logp_sum"), F.round(weighted, 4).alias("logp_weighted"))


def long_pairs(spark, sf):
    """(pos, vocab_id, teacher, student), dealt by position and entry, so no task has a whole position."""
    p = pairs(spark, sf).select("pos", F.posexplode(F.arrays_zip("teacher", "student")).alias("vocab_id", "x"))
    return p.select("pos", "vocab_id", F.col("x.teacher").alias("teacher"), F.col("x.student").alias("student")).repartition("pos", "vocab_id")


@register("d1_long_log_softmax", sql=SQL_PAIRS + """
SELECT pos, round(lse_t, 6) AS lse, round(list_sum(lp_t), 6) AS logp_sum,
       round(list_sum(list_transform(list_zip(lp_t, range(len(lp_t))), lambda z: z[1] * (z[2] + 1))), 4) AS logp_weighted FROM lp""")
def d1_long_log_softmax(spark, sf):
    lp = D.log_softmax_long(long_pairs(spark, sf), logit="teacher")
    g = lp.groupBy("pos").agg(F.max(F.col("teacher") - F.col("logp")).alias("lse"), F.sum("logp").alias("s"), F.sum(F.col("logp") * (F.col("vocab_id") + 1)).alias("w"))
    return g.select("pos", F.round("lse", 6).alias("lse"), F.round("s", 6).alias("logp_sum"), F.round("w", 4).alias("logp_weighted"))


@register("d2_long_kl", sql=SQL_PAIRS + " SELECT pos, round(kl, 6) AS kl FROM kl")
def d2_long_kl(spark, sf):
    return D.kl_long(long_pairs(spark, sf)).select("pos", F.round("kl", 6).alias("kl"))


@register("d2_kl_divergence", sql=SQL_PAIRS + " SELECT pos, round(kl, 6) AS kl FROM kl")
def d2_kl_divergence(spark, sf):
    return pairs(spark, sf).select("pos", F.round(D.kl_row(F.col("teacher"), F.col("student")), 6).alias("kl"))


@register("d2_kl_batch_mean", sql=SQL_PAIRS + " SELECT count(*) AS n, round(avg(kl), 6) AS kl FROM kl")
def d2_kl_batch_mean(spark, sf):
    b = D.batch_kl(pairs(spark, sf))
    return b.select("n", F.round("kl", 6).alias("kl"))


@register("d3_kl_gradient", sql=SQL_PAIRS + """,
g AS (SELECT pos, list_transform(list_zip(lp_s, lp_t), lambda z: (exp(z[1]) - exp(z[2])) / nn) AS grad
      FROM kl, (SELECT n AS nn FROM n))
SELECT pos, round(list_sum(list_transform(grad, lambda x: abs(x))), 6) AS grad_l1, round(list_max(list_transform(grad, lambda x: abs(x))), 6) AS grad_max FROM g""")
def d3_kl_gradient(spark, sf):
    p = pairs(spark, sf)
    n = p.agg(F.count(F.lit(1)).alias("n"))
    g = p.join(F.broadcast(n)).select("pos", D.kl_grad(F.col("teacher"), F.col("student"), F.col("n")).alias("g"))  # one row
    return g.select("pos", F.round(D._sum(F.transform("g", F.abs)), 6).alias("grad_l1"),
                    F.round(F.array_max(F.transform("g", F.abs)), 6).alias("grad_max"))


@register("d4_cross_entropy", sql=SQL_PAIRS + """,
nx AS (SELECT a.layer, a.lp_s, b.layer AS target FROM kl a JOIN kl b ON b.pos = a.pos + 1)
SELECT layer, count(*) AS n, round(avg(-lp_s[target + 1]), 6) AS ce_loss, round(exp(avg(-lp_s[target + 1])), 6) AS perplexity
FROM nx GROUP BY layer""")
def d4_cross_entropy(spark, sf):
    """The token of a position is the row's label and its target the next position's; CE and perplexity per label."""
    p = D.next_targets(pairs(spark, sf), token="layer")
    c = D.cross_entropy(p, "student", "target", ["layer"])
    return c.select("layer", "n", F.round("ce_loss", 6).alias("ce_loss"), F.round("perplexity", 6).alias("perplexity"))


@register("d5_alignment_loss", sql=SQL_PAIRS + """
SELECT layer, round(avg(align), 6) AS align_loss FROM kl GROUP BY layer""")
def d5_alignment_loss(spark, sf):
    p = pairs(spark, sf)
    return p.groupBy("layer").agg(F.round(F.avg(D.alignment_row(F.col("teacher"), F.col("student"))), 6).alias("align_loss"))


@register("d6_layer_mean", sql=SQL_PAIRS + """
SELECT count(*) AS n_layers, round(coalesce(avg(a), 0) * 1.0, 6) AS layer_mean
FROM (SELECT layer, avg(align) AS a FROM kl GROUP BY layer)""")
def d6_layer_mean(spark, sf):
    p = pairs(spark, sf)
    per = p.groupBy("layer").agg(F.avg(D.alignment_row(F.col("teacher"), F.col("student"))).alias("a"))
    m = D.layer_mean(per, "a", 1.0)
    return m.select("n_layers", F.round("layer_mean", 6).alias("layer_mean"))


@register("d7_projected_kl", sql="""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
wt AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vi, v AS w FROM e WHERE label = """ + str(W_LABEL) + """),
ws AS (SELECT vi, list_transform(list_zip(w, list_reverse(w)), lambda z: 0.5 * (z[1] + z[2])) AS w FROM wt),
pairs AS (SELECT t.vec_id AS pos, t.v AS teacher, s.v AS student
          FROM e t JOIN e s ON t.vec_id = (s.vec_id - 1 + (SELECT n FROM n)) % (SELECT n FROM n)),
lg AS (SELECT p.pos, wt.vi, list_dot_product(p.teacher, wt.w) AS lt, list_dot_product(p.student, ws.w) AS ls FROM pairs p, wt JOIN ws USING (vi)),
m AS (SELECT pos, max(lt) AS mt, max(ls) AS ms FROM lg GROUP BY pos),
agg AS (SELECT lg.pos, m.mt, m.ms, sum(exp(lt - m.mt)) AS zt, sum(exp(lt - m.mt) * (lt - ls)) AS a_t, sum(exp(ls - m.ms)) AS zs
        FROM lg JOIN m USING (pos) GROUP BY lg.pos, m.mt, m.ms)
SELECT pos, round(a_t / zt - (mt + ln(zt)) + (ms + ln(zs)), 6) AS kl FROM agg""")
def d7_projected_kl(spark, sf):
    """Teacher and student have a projection matrix each."""
    e = read_table(spark, sf, "embeddings").filter(F.col("label") == W_LABEL)
    order = prefix.dense_index(e.select("vec_id"), "vec_id", "v")
    w = e.join(order, "vec_id").select("v", F.transform("embedding", lambda x: x.cast("double")).alias("teacher"))
    w = w.withColumn("student", F.zip_with("teacher", F.reverse("teacher"), lambda a, b: F.lit(0.5) * (a + b)))
    kl = D.projected_kl(pairs(spark, sf), w, BLOCK_ROWS, TILE, WIDTH, GROUPS)
    return kl.select("pos", F.round("kl", 6).alias("kl"))
