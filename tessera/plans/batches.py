"""L1-L5 on the 512-token chunk table built from ``documents``; L3 parameters from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_permuted
from ..operators import batching as L
from ..operators import pack
from ..session import scratch_path
from ..sources.corpus import read_table
from . import corpus as C
from .registry import register

SEED, EPOCH, BATCH = 1234, 0, 8


def chunks(spark, sf):
    off = pack.token_offsets(C.encoded(spark, sf))
    return pack.pack_chunks(off, C.CHUNK_LEN)


SQL_CH = "WITH RECURSIVE " + C.sql_stream() + f""",
chunks AS ({C.sql_chunks(C.CHUNK_LEN)}),""" + sql_permuted("chunks", ["chunk_id", "ids_md5"], "chunk_id", "(SELECT count(*) FROM chunks)", str(SEED), str(EPOCH)) + """,
ord AS (SELECT * FROM permuted)"""


@register("l1_epoch_shuffle", sql=SQL_CH + " SELECT chunk_id, pos FROM ord")
def l1_epoch_shuffle(spark, sf):
    return L.epoch_order(chunks(spark, sf), SEED, EPOCH).select("chunk_id", "pos")


@register("l2_collate", sql=SQL_CH + f"""
SELECT CAST(pos // {BATCH} AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS n_rows,
       string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY pos) AS chunk_ids,
       md5(string_agg(ids_md5, ',' ORDER BY pos)) AS batch_md5
FROM ord GROUP BY 1""")
def l2_collate(spark, sf):
    b = L.collate(L.epoch_order(chunks(spark, sf), SEED, EPOCH), BATCH)
    return b.select("batch_id", F.size("chunk_ids").alias("n_rows"),
                    F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"),
                    F.md5(F.array_join(F.transform("input_ids", lambda a: F.md5(F.array_join(a, ","))), ",")).alias("batch_md5"))


def run_params(spark, sf):
    """One training run per order priority, parameters derived from its orders."""
    o = read_table(spark, sf, "orders")
    g = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("tp"))
    return g.select(F.col("o_orderpriority").alias("run"),
                    F.when(F.col("n") % 2 == 0, F.floor(F.col("tp")).cast("long") * 100).alias("target_tokens"),
                    (F.col("n") % 500 + 100).cast("long").alias("max_steps"),
                    (8 * (1 + F.col("n") % 12)).cast("int").alias("batch_size"),
                    (1 + F.col("n") % 4).cast("int").alias("micro_batch_size"),
                    F.when(F.col("n") % 3 == 0, 4096).otherwise(512).cast("int").alias("seq_len"),
                    F.lit(8).alias("world_size"))


@register("l3_budget_plan", sql="WITH " + C.sql_vocab() + "," + C.sql_token_rows() + """,
tot AS (SELECT count(*) AS total_tokens FROM ids),
g AS (SELECT o_orderpriority AS run, count(*) AS n, sum(o_totalprice) AS tp FROM orders GROUP BY 1),
p AS (SELECT run, CASE WHEN n % 2 = 0 THEN CAST(floor(tp) AS BIGINT) * 100 END AS target_tokens, n % 500 + 100 AS max_steps,
             8 * (1 + n % 12) AS batch_size, 1 + n % 4 AS micro_batch_size, CASE WHEN n % 3 = 0 THEN 4096 ELSE 512 END AS seq_len,
             8 AS world_size FROM g),
a AS (SELECT *, greatest(1, CAST(ceil(batch_size / (micro_batch_size * world_size)) AS BIGINT)) AS accum_steps FROM p),
e AS (SELECT *, micro_batch_size * world_size * accum_steps AS effective_batch FROM a),
s AS (SELECT *, CASE WHEN target_tokens IS NOT NULL AND target_tokens > 0
                     THEN greatest(1, target_tokens // (effective_batch * seq_len)) ELSE max_steps END AS total_steps FROM e)
SELECT run, CAST(accum_steps AS BIGINT) AS accum_steps, CAST(effective_batch AS BIGINT) AS effective_batch,
       CAST(total_steps AS BIGINT) AS total_steps,
       CAST(ceil(total_steps * effective_batch * seq_len / (tot.total_tokens // seq_len * seq_len)) AS BIGINT) AS epochs_needed
FROM s, tot""")
def l3_budget_plan(spark, sf):
    plan = L.budget_plan(run_params(spark, sf))
    total = pack.packing_stats(C.encoded(spark, sf), 1).select("total_tokens")
    plan = plan.join(F.broadcast(total))  # one row
    usable = F.expr("total_tokens div seq_len * seq_len")
    return plan.select("run", "accum_steps", "effective_batch", "total_steps",
                    F.ceil(F.col("total_steps") * F.col("effective_batch") * F.col("seq_len") / usable).cast("long")
                    .alias("epochs_needed"))


SQL_L4 = "WITH RECURSIVE " + C.sql_stream() + f""",
chunks AS ({C.sql_chunks(C.CHUNK_LEN)}),
n AS (SELECT count(*) AS n FROM chunks),
g0 AS (SELECT o_orderpriority AS run, count(*) AS c FROM orders GROUP BY 1),
p AS (SELECT run, n, n * {C.CHUNK_LEN} * (1 + c % 5) // 2 AS target_tokens, 8 * (1 + c % 12) AS batch, 1 + c % 4 AS micro, 1 + c % 2 AS world FROM g0, n),
a AS (SELECT *, greatest(1, CAST(ceil(batch / (micro * world)) AS BIGINT)) AS accum FROM p),
e AS (SELECT *, micro * world * accum AS eff FROM a),
s AS (SELECT *, greatest(1, target_tokens // (eff * {C.CHUNK_LEN})) * eff AS rows_ FROM e WHERE n > 0),
ep AS (SELECT unnest(range((SELECT max((rows_ + n - 1) // n) FROM s))) AS epoch),
each AS (SELECT epoch, chunk_id FROM chunks, ep),""" + sql_permuted("each", ["epoch", "chunk_id"], "chunk_id", "(SELECT n FROM n)", str(SEED), "epoch") + f""",
o AS (SELECT epoch, chunk_id, epoch * (SELECT n FROM n) + pos AS g FROM permuted)
SELECT run, CAST(epoch AS INTEGER) AS epoch, chunk_id, CAST(g // eff AS BIGINT) AS step, CAST((g % eff) // (micro * world) AS BIGINT) AS accum_slot,
       CAST(((g % eff) % (micro * world)) // micro AS BIGINT) AS rank, CAST(((g % eff) % (micro * world)) % micro AS BIGINT) AS lane
FROM o, s WHERE g < rows_"""


@register("l4_assign_steps", sql=SQL_L4)
def l4_assign_steps(spark, sf):
    """One run per order priority, each with a token budget of half an epoch to two and a half."""
    ch = chunks(spark, sf).select("chunk_id", F.lit(C.CHUNK_LEN).alias("chunk_len"))
    path = scratch_path(spark, "chunk-ids")
    ch.write.parquet(path)
    ch = spark.read.parquet(path)
    n = ch.agg(F.count(F.lit(1)).alias("n"))
    c = read_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count(F.lit(1)).alias("c"))
    params = c.join(F.broadcast(n)).select(  # one row
        "run", F.expr(f"n * {C.CHUNK_LEN} * (1 + c % 5) div 2").alias("target_tokens"), F.lit(None).cast("long").alias("max_steps"),
        (8 * (1 + F.col("c") % 12)).alias("batch_size"), (1 + F.col("c") % 4).alias("micro_batch_size"),
        (1 + F.col("c") % 2).alias("world_size"), F.lit(C.CHUNK_LEN).alias("seq_len"))
    a = L.assign_steps(ch, L.budget_plan(params), SEED)
    return a.select("run", "epoch", "chunk_id", *[F.col(x).cast("long").alias(x) for x in ("step", "accum_slot", "rank", "lane")])


@register("l5_shift_labels", sql="WITH " + C.sql_stream() + f""",
c AS (SELECT gpos // {C.CHUNK_LEN} AS chunk_id, gpos % {C.CHUNK_LEN} AS j, token_id FROM stream),
full_ AS (SELECT chunk_id FROM c GROUP BY chunk_id HAVING count(*) = {C.CHUNK_LEN})
SELECT CAST(c.chunk_id AS BIGINT) AS chunk_id,
  md5(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY j) FILTER (WHERE j < {C.CHUNK_LEN - 1})) AS inputs_md5,
  md5(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY j) FILTER (WHERE j > 0)) AS targets_md5,
  md5(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY j) FILTER (WHERE j > 0) || ',{L.IGNORE_INDEX}') AS labels_md5
FROM c JOIN full_ USING (chunk_id) GROUP BY c.chunk_id""")
def l5_shift_labels(spark, sf):
    s = L.shift_labels(L.shift_labels(chunks(spark, sf)), keep_length=True)
    md = lambda c: F.md5(F.array_join(F.col(c), ","))
    return s.select("chunk_id", md("inputs").alias("inputs_md5"), md("targets").alias("targets_md5"),
                    md("labels").alias("labels_md5"))
