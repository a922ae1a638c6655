"""W1-W8 on ``embeddings`` as tensor rows (label -> tensor name) and ``part``
names as checkpoint keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prefix
from ..operators import tensors as W
from ..sources.corpus import read_table
from .registry import register

# Tensor name per embeddings.label (source layout).
TENSOR_NAMES = [
    "model.embed_tokens.weight",
    "model.layers.0.self_attn.q_proj.weight",
    "model.layers.0.self_attn.k_proj.weight",
    "model.layers.0.input_layernorm.weight",
    "model.layers.0.mlp.up_proj.weight",
    "model.layers.1.self_attn.q_proj.weight",
    "model.layers.1.post_attention_layernorm.weight",
    "model.layers.1.mlp.down_proj.weight",
    "model.norm.weight",
    "lm_head.weight",
]
SPARSITY = 0.5
KEEP_LAYERS = [1]
GROUPS = 2
TRUNC_ROWS, TRUNC_COLS = 20, 16
PERTURBED_LABEL = 3

_names_sql = "[" + ", ".join(f"'{n}'" for n in TENSOR_NAMES) + "]"


def tensors(spark, sf, mapped: bool = False):
    e = read_table(spark, sf, "embeddings")
    names = F.array(*[F.lit(n) for n in TENSOR_NAMES])
    name = F.element_at(names, (F.col("label") + 1).cast("int"))
    if mapped:
        name = W.map_name(name)
    return e.select(name.alias("name"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("values"))


SQL_T = f"""
WITH t AS (SELECT {_names_sql}[label + 1] AS name, vec_id AS row_id, embedding AS vals FROM embeddings),
el AS (SELECT t.name, t.row_id, CAST(unnest(t.vals) AS DOUBLE) AS w FROM t)"""


FROZEN = ["model.embed_tokens.weight"]
ATTN_RATE, OTHER_RATE = 1e-3, 1e-4


@register("w1_parameter_groups", sql=SQL_T + f""",
p AS (SELECT name, CAST(sum(len(vals)) AS BIGINT) AS numel, name NOT IN ({", ".join(f"'{n}'" for n in FROZEN)}) AS requires_grad FROM t GROUP BY name),
g AS (SELECT CASE WHEN contains(name, 'attn') THEN 'attn' ELSE 'other' END AS "group", sum(numel) AS n_params,
       sum(CASE WHEN requires_grad THEN numel ELSE 0 END) AS n_trainable FROM p GROUP BY 1)
SELECT "group", n_params, n_trainable, round(n_trainable / n_params, 6) AS trainable_share,
       CASE WHEN n_trainable > 0 THEN CASE "group" WHEN 'attn' THEN {ATTN_RATE} ELSE {OTHER_RATE} END END::DOUBLE AS learning_rate,
       CASE WHEN n_params >= 1048576 THEN printf('%.2fMi', n_params / 1048576.0) WHEN n_params >= 1024 THEN printf('%.2fKi', n_params / 1024.0)
            ELSE CAST(n_params AS VARCHAR) END AS n_params_text FROM g""")
def w1_parameter_groups(spark, sf):
    g = W.parameter_groups(W.parameter_table(tensors(spark, sf), FROZEN), ATTN_RATE, OTHER_RATE)
    return g.withColumn("trainable_share", F.round("trainable_share", 6))


SQL_THR = f""",
st AS (SELECT name, count(*) AS n, CAST(floor(count(*) * {SPARSITY}) AS BIGINT) AS k FROM el GROUP BY name),
rk AS (SELECT el.name, abs(w) AS a, row_number() OVER (PARTITION BY el.name ORDER BY abs(w)) AS rn FROM el),
thr AS (SELECT st.name, st.n, st.k, CASE WHEN st.k > 0 THEN rk.a END AS threshold
        FROM st LEFT JOIN rk ON rk.name = st.name AND rk.rn = st.k)"""


@register("w2_magnitude_mask", sql=SQL_T + SQL_THR + """
SELECT thr.name, thr.n, thr.k, round(thr.threshold, 6) AS threshold,
       CAST(sum(CASE WHEN thr.threshold IS NULL OR abs(el.w) > thr.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
FROM thr JOIN el USING (name) GROUP BY thr.name, thr.n, thr.k, thr.threshold""")
def w2_magnitude_mask(spark, sf):
    t = tensors(spark, sf)
    thr = W.magnitude_threshold(t, SPARSITY)
    m = W.apply_mask(t, thr)
    kept = m.groupBy("name").agg(F.sum(F.size(F.filter("mask", lambda x: x))).cast("long").alias("n_kept"))
    return thr.join(kept, "name").select("name", "n", "k", F.round("threshold", 6).alias("threshold"), "n_kept")


@register("w3_masked_sparsity", sql=SQL_T + SQL_THR + """
SELECT thr.name, round(avg(CASE WHEN thr.threshold IS NULL OR abs(el.w) > thr.threshold THEN 0.0 ELSE 1.0 END), 6) AS achieved_sparsity,
       round(sum(CASE WHEN thr.threshold IS NULL OR abs(el.w) > thr.threshold THEN el.w ELSE 0.0 END), 6) AS masked_sum
FROM thr JOIN el USING (name) GROUP BY thr.name""")
def w3_masked_sparsity(spark, sf):
    t = tensors(spark, sf)
    a = W.achieved_sparsity(W.apply_mask(t, W.magnitude_threshold(t, SPARSITY)))
    return a.select("name", F.round("achieved_sparsity", 6).alias("achieved_sparsity"),
                    F.round("masked_sum", 6).alias("masked_sum"))


def _raw_keys(df_key_col):
    """Checkpoint-style keys from part names, wrapped four ways by p_partkey mod 4."""
    base = F.concat(F.lit("model.layers."), (F.col("p_partkey") % 28).cast("string"), F.lit("."),
                    F.regexp_replace("p_name", " ", "_"))
    m = F.col("p_partkey") % 4
    return (F.when(m == 0, F.concat(F.lit("module."), base, F.lit(".weight")))
            .when(m == 1, F.concat(F.lit("_forward_module.module."), base, F.lit(".weight")))
            .when(m == 2, F.concat(base, F.lit(".student_attn.weight")))
            .otherwise(F.concat(base, F.lit(".teacher_attn.weight"))))


@register("w4_clean_keys", sql="""
WITH k AS (SELECT p_partkey, 'model.layers.' || (p_partkey % 28) || '.' || replace(p_name, ' ', '_') AS base FROM part),
raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'module.' || base || '.weight'
                                              WHEN 1 THEN '_forward_module.module.' || base || '.weight'
                                              WHEN 2 THEN base || '.student_attn.weight'
                                              ELSE base || '.teacher_attn.weight' END AS key FROM k),
c AS (SELECT p_partkey, regexp_replace(key, '^(_forward_module\\.|module\\.)+', '') AS key FROM raw)
SELECT p_partkey, replace(key, '.student_attn', '') AS key FROM c WHERE NOT contains(key, '.teacher_attn')""")
def w4_clean_keys(spark, sf):
    p = read_table(spark, sf, "part").select("p_partkey", _raw_keys(None).alias("key"))
    return W.clean_keys(p, "key")


STUDENT_NAME = "model.layers.1.self_attn.g_proj.weight"  # the student's own name for the tensor with label 5
_kept_sql = f"contains(name, 'attn') AND coalesce(TRY_CAST(regexp_extract(name, '^model\\.layers\\.(\\d+)\\.', 1) AS INTEGER) IN ({', '.join(map(str, KEEP_LAYERS))}), false)"


def _hybrid(spark, sf):
    """A student with halved values, one attention tensor under a name of its own, and no ``lm_head``."""
    teacher = tensors(spark, sf)
    student = (teacher.withColumn("values", F.transform("values", lambda x: (x * 0.5).cast("float")))
               .withColumn("name", F.when(F.col("name") == TENSOR_NAMES[5], F.lit(STUDENT_NAME)).otherwise(F.col("name")))
               .filter(F.col("name") != "lm_head.weight"))
    keep = spark.createDataFrame([(x,) for x in KEEP_LAYERS], "layer int")
    return teacher, W.hybrid_merge(teacher, student, keep)


SQL_HYBRID = SQL_T + f""",
st AS (SELECT CASE WHEN name = '{TENSOR_NAMES[5]}' THEN '{STUDENT_NAME}' ELSE name END AS name, row_id, vals FROM t WHERE name <> 'lm_head.weight'),
merged AS (SELECT name, row_id, 'teacher' AS source, vals, 1.0 AS f FROM t WHERE {_kept_sql}
           UNION ALL SELECT name, row_id, 'student', vals, 0.5 FROM st WHERE NOT ({_kept_sql}))"""


@register("w5_hybrid_merge", sql=SQL_HYBRID + """
SELECT name, row_id, source, round(list_sum(list_transform(vals, lambda x: CAST(x AS DOUBLE) * f)), 6) AS vsum FROM merged""")
def w5_hybrid_merge(spark, sf):
    return _hybrid(spark, sf)[1].select("name", "row_id", "source", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vsum"))


@register("w5_missing_keys", sql=SQL_HYBRID + " SELECT DISTINCT name FROM t WHERE name NOT IN (SELECT name FROM merged)")
def w5_missing_keys(spark, sf):
    teacher, merged = _hybrid(spark, sf)
    return W.missing_keys(merged, teacher)


@register("w6_repeat_rows", sql=SQL_T + f"""
SELECT name, row_id * {GROUPS} + j AS row_id, row_id AS src_row FROM t, range({GROUPS}) g(j)""")
def w6_repeat_rows(spark, sf):
    return W.repeat_rows(tensors(spark, sf), GROUPS).select("name", "row_id", "src_row")


@register("w7_truncate", sql=SQL_T + f""",
r AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY row_id) - 1 AS row_id, vals FROM t)
SELECT name, row_id, CAST(len(vals[1:{TRUNC_COLS}]) AS INTEGER) AS n_cols,
       round(list_sum(list_transform(vals[1:{TRUNC_COLS}], lambda x: CAST(x AS DOUBLE))), 6) AS vsum
FROM r WHERE row_id < {TRUNC_ROWS}""")
def w7_truncate(spark, sf):
    """Row ids count within each tensor."""
    t = tensors(spark, sf)
    order = prefix.dense_index(t.select("name", "row_id"), ["name", "row_id"], "_i")
    order = order.join(order.groupBy("name").agg(F.min("_i").alias("_first")), "name")
    t = t.join(order, ["name", "row_id"]).select("name", (F.col("_i") - F.col("_first")).alias("row_id"), "values")
    t = W.truncate_tensor(t, TRUNC_ROWS, TRUNC_COLS)
    return t.select("name", "row_id", F.size("values").alias("n_cols"),
                    F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vsum"))


def _sql_map(c: str) -> str:
    for a, b in W.NAME_MAP:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@register("w8_parity_audit", sql=SQL_T + f""",
s AS (SELECT {_sql_map('name')} AS name, row_id, vals AS sv FROM t),
tg AS (SELECT {_sql_map('name')} AS name, row_id,
         CASE WHEN row_id % 7 = 0 AND name = '{TENSOR_NAMES[PERTURBED_LABEL]}' THEN list_transform(vals, lambda x: CAST(x * 1.01 AS FLOAT))
              ELSE vals END AS tv FROM t WHERE row_id % 50 <> 1),
j AS (SELECT coalesce(s.name, tg.name) AS name, s.sv, tg.tv FROM s FULL OUTER JOIN tg ON s.name = tg.name AND s.row_id = tg.row_id)
SELECT name,
  round(max(CASE WHEN sv IS NOT NULL AND tv IS NOT NULL THEN list_max(list_transform(list_zip(sv, tv), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) END), 6) AS max_abs_diff,
  sum(CASE WHEN sv IS NOT NULL AND tv IS NOT NULL THEN len(list_filter(list_zip(sv, tv), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) > {W.TOLERANCES['float32'][1]} + {W.TOLERANCES['float32'][0]} * abs(CAST(z[2] AS DOUBLE)))) ELSE 0 END) AS n_mismatch,
  sum(CASE WHEN tv IS NULL THEN 1 ELSE 0 END) AS missing_rows,
  sum(CASE WHEN sv IS NULL THEN 1 ELSE 0 END) AS extra_rows
FROM j GROUP BY name""")
def w8_parity_audit(spark, sf):
    """Target = renamed copy with one tensor perturbed on every 7th row and
    every 50th row (offset 1) missing."""
    src = tensors(spark, sf)
    tgt = tensors(spark, sf, mapped=False)
    tgt = tgt.withColumn("values", F.when((F.col("row_id") % 7 == 0) & (F.col("name") == TENSOR_NAMES[PERTURBED_LABEL]),
                                          F.transform("values", lambda x: (x * 1.01).cast("float"))).otherwise(F.col("values")))
    tgt = tgt.filter(F.col("row_id") % 50 != 1).withColumn("name", W.map_name(F.col("name")))
    rtol, atol = W.TOLERANCES["float32"]
    a = W.parity_audit(src, tgt, rtol, atol)
    return a.select("name", F.round("max_abs_diff", 6).alias("max_abs_diff"), "n_mismatch", "missing_rows", "extra_rows")
