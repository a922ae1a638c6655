"""Epoch shuffle, batch collation, token-budget plan, step assignment,
next-token pairs over a chunk table ``(chunk_id, input_ids)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prefix
from ..functions.hashing import permuted

IGNORE_INDEX = -100


def _dense(chunks: DataFrame, key: str) -> tuple[DataFrame, int, str]:
    """The table, its row count and a column that numbers its rows 0 .. n - 1: the key itself where it does
    (as chunk ids do; one count shows it), else a new ``_index`` in key order."""
    n, lo, hi, types = chunks.agg(F.count(F.lit(1)), F.min(key), F.max(key), F.count_distinct(key)).first()
    if n == 0 or (lo == 0 and hi == n - 1 and types == n):
        return chunks, n, key
    return chunks.join(prefix.dense_index(chunks.select(key), key, "_index"), key), n, "_index"


def epoch_order(chunks: DataFrame, seed: int, epoch: int, key: str = "chunk_id", n: int | None = None) -> DataFrame:
    """L1: a seeded permutation per epoch as a dense 0-based ``pos``.

    ``pos`` is a keyed bijection of the row's own number, so an epoch needs no sort, exchange or join: any
    task can tell where a chunk stands. Chunk ids are dense; another unique key is numbered once first. ``n``: the number
    of rows, where the caller knows that ``key`` is dense.
    """
    index, drop = key, []
    if n is None:
        chunks, n, index = _dense(chunks, key)
        drop = ["_index"] if index != key else []
    return chunks.withColumn("pos", permuted(f"`{index}`", f"{n}L", str(int(seed)), str(int(epoch)))).drop(*drop).withColumn("epoch", F.lit(epoch))


def collate(ordered: DataFrame, batch_size: int, ids_col: str = "input_ids") -> DataFrame:
    """L2: ``batch_size`` consecutive rows -> one batch ``[B, T]`` (last partial
    batch kept).  Each group holds at most ``batch_size`` rows."""
    return (ordered.groupBy(F.expr(f"pos div {int(batch_size)}").alias("batch_id"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", ids_col))).alias("_b"))
            .select("batch_id", F.col("_b.chunk_id").alias("chunk_ids"), F.col(f"_b.{ids_col}").alias(ids_col)))


def budget_plan(params: DataFrame) -> DataFrame:
    """L3: ``accum = max(1, ceil(batch/(micro*world)))``, ``eff = micro*world*accum``,
    ``steps = max(1, target div (eff*seq))`` or the given ``max_steps``."""
    accum = F.greatest(F.lit(1), F.ceil(F.col("batch_size") / (F.col("micro_batch_size") * F.col("world_size"))))
    p = params.withColumn("accum_steps", accum.cast("long"))
    p = p.withColumn("effective_batch", (F.col("micro_batch_size") * F.col("world_size") * F.col("accum_steps")).cast("long"))
    steps = F.when(F.col("target_tokens").isNotNull() & (F.col("target_tokens") > 0),
                   F.greatest(F.lit(1), F.floor(F.col("target_tokens") / (F.col("effective_batch") * F.col("seq_len")))))
    return p.withColumn("total_steps", F.coalesce(steps, F.col("max_steps")).cast("long"))


def assign_steps(chunk_ids: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """L4: (run, epoch, chunk_id) -> step, accumulation slot, rank and lane, for every step of every run.

    Chunk ids of a length are dense (0 .. n - 1), as packing makes them; places come from L1's bijection in the row.

    ``chunk_ids``: (chunk_id, chunk_len); ``plan``: L3's rows with ``run, seq_len, micro_batch_size,
    world_size, accum_steps, effective_batch, total_steps`` (one row per run).  A run reads chunks of its
    own length, epoch after epoch in L1's order, until its steps are filled: the number of epochs
    follows from the steps and from how many chunks of that length there are.
    """
    have = chunk_ids.groupBy("chunk_len").agg(F.count(F.lit(1)).alias("n_chunks"))
    plan = (plan.join(have, F.col("seq_len") == F.col("chunk_len")).drop("seq_len")
            .withColumn("_rows", F.col("total_steps") * F.col("effective_batch")))
    epochs = plan.groupBy("chunk_len").agg(F.max(F.expr("(_rows + n_chunks - 1) div n_chunks")).alias("_epochs"))
    # one narrow row for each epoch and chunk that some run reads; positions count on across epochs
    narrow = (chunk_ids.join(F.broadcast(epochs), "chunk_len")  # one row per chunk length
              .select("chunk_len", "chunk_id", F.explode(F.sequence(F.lit(0), F.col("_epochs").cast("int") - 1)).alias("epoch")))
    placed = narrow.join(F.broadcast(have), "chunk_len")  # one row per chunk length
    placed = placed.withColumn("_g", F.col("epoch") * F.col("n_chunks") + permuted("chunk_id", "n_chunks", str(int(seed)), "epoch")).drop("n_chunks")
    runs = plan.drop("n_chunks")
    return (placed.join(F.broadcast(runs), "chunk_len").filter("_g < _rows")  # one row per run
            .select("run", "epoch", "chunk_id", F.expr("_g div effective_batch").alias("step"),
                    F.expr("_g % effective_batch div (micro_batch_size * world_size)").alias("accum_slot"),
                    F.expr("_g % effective_batch % (micro_batch_size * world_size) div micro_batch_size").alias("rank"),
                    F.expr("_g % effective_batch % (micro_batch_size * world_size) % micro_batch_size").alias("lane")))


def shift_labels(df: DataFrame, ids_col: str = "input_ids", keep_length: bool = False,
                 ignore: int = IGNORE_INDEX) -> DataFrame:
    """Next-token pairs.  Default: inputs ``[:-1]``, targets ``[1:]``;
    ``keep_length``: labels ``ids[1:] + [ignore]``."""
    ids = F.col(ids_col)
    if keep_length:
        return df.withColumn("labels", F.array_append(F.slice(ids, 2, F.size(ids)), F.lit(ignore)))
    n = F.size(ids) - 1
    return df.withColumn("inputs", F.slice(ids, 1, n)).withColumn("targets", F.slice(ids, 2, n))
