"""Concatenate a token stream and cut it into fixed-length chunks.

The reference flattens the whole corpus into one in-memory array.  Here the
stream is never materialised: each document knows its global start offset
(C1, a two-level prefix sum), emits the slices that fall into each chunk
(C2, built inside ``transform`` so the id array is never copied per chunk),
and one shuffle on ``chunk_id`` reassembles chunks from at most ``C`` parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prefix
from ..session import scratch_path


def token_offsets(tokens: DataFrame, order_key: str = "doc_id", ids_col: str = "input_ids",
                  rows_per_range: int = prefix.ROWS_PER_RANGE) -> DataFrame:
    """Adds ``n_tokens`` and ``start`` (global offset of the first token) to every document.

    The encoded table is written once, so the tokenizer runs once; only (key, length) go
    through the running sum, and the offsets are joined back on the key.  A null key has
    no place in the order and fails the job; an empty document has the offset of the next one.
    """
    spark = tokens.sparkSession
    key = F.when(F.col(order_key).isNull(), F.raise_error(F.lit(f"null in the order key {order_key}"))).otherwise(F.col(order_key))
    path = scratch_path(spark, "tokens")
    (tokens.withColumn(order_key, key).withColumn("n_tokens", F.coalesce(F.size(ids_col), F.lit(0)).cast("long"))
     .write.parquet(path))
    sized = spark.read.parquet(path)
    starts = prefix.running_total(sized.select(order_key, "n_tokens"), order_key, "n_tokens", "start", rows_per_range=rows_per_range)
    return sized.join(starts.select(order_key, "start"), order_key)


def pack_chunks(offsets: DataFrame, chunk_len: int, ids_col: str = "input_ids") -> DataFrame:
    """Rows of exactly ``chunk_len`` ids; the tail ``total mod C`` is dropped.

    Output ``chunk_id LONG, input_ids ARRAY<INT>``.
    """
    C = int(chunk_len)
    offsets = offsets.filter("n_tokens > 0")

    parts = offsets.select(F.expr(f"""inline(transform(sequence(start div {C}, (start + n_tokens - 1) div {C}), c -> struct(
        c as chunk_id, greatest(start, c * {C}) as lo,
        slice({ids_col}, cast(greatest(start, c * {C}) - start + 1 as int),
              cast(least(start + n_tokens, (c + 1) * {C}) - greatest(start, c * {C}) as int)) as ids)))"""))
    return (parts.groupBy("chunk_id")
            .agg(F.array_sort(F.collect_list(F.struct("lo", "ids"))).alias("_p"))
            .select("chunk_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias(ids_col))
            .filter(F.size(ids_col) == C))


def packing_stats(tokens: DataFrame, chunk_len: int, ids_col: str = "input_ids") -> DataFrame:
    """Total, usable and dropped tokens and the number of chunks (one aggregate)."""
    C = int(chunk_len)
    total = F.coalesce(F.sum(F.size(ids_col).cast("long")), F.lit(0)).cast("long")
    return (tokens.agg(total.alias("total_tokens"))
            .select(F.lit(C).alias("chunk_len"), "total_tokens",
                    F.expr(f"total_tokens div {C} * {C}").alias("usable_tokens"),
                    (F.col("total_tokens") % C).cast("long").alias("dropped_tokens"),
                    F.expr(f"total_tokens div {C}").alias("num_chunks")))


def pack_many(offsets: DataFrame, lengths: list[int], ids_col: str = "input_ids") -> DataFrame:
    """C4: the same offsets cut at several lengths (e.g. 512 and 4096).

    Where each length divides the next, ids move once: only the shortest chunks are cut from
    documents, and longer ones are put together from whole shorter ones; a tail shorter than
    the longest chunk is dropped for each length on its own.  Other lengths are cut one by one.
    """
    lengths = sorted(set(int(c) for c in lengths))
    nested = all(b % a == 0 for a, b in zip(lengths, lengths[1:]))
    out, base = None, None
    for C in lengths:
        if base is None or not nested:
            part = base = pack_chunks(offsets, C, ids_col)
            if nested and len(lengths) > 1:
                path = scratch_path(offsets.sparkSession, "chunks")
                base.write.parquet(path)
                part = base = offsets.sparkSession.read.parquet(path)
        else:
            k = C // lengths[0]
            part = (base.groupBy(F.expr(f"chunk_id div {k}").alias("long_id"))
                    .agg(F.array_sort(F.collect_list(F.struct("chunk_id", ids_col))).alias("_p"))
                    .filter(F.size("_p") == k)
                    .select(F.col("long_id").alias("chunk_id"), F.flatten(F.col(f"_p.{ids_col}")).alias(ids_col)))
        part = part.withColumn("chunk_len", F.lit(C))
        out = part if out is None else out.unionByName(part)
    return out


def corpus_fingerprint(texts: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row count and two order-free checksums over keys and whole texts, which name the C5 cache path."""
    one, two = F.xxhash64(key, text_col), F.xxhash64(F.lit(1), F.lower(F.md5(F.coalesce(F.col(text_col), F.lit("")))), key)
    return texts.agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias(c) for h, c in ((one, "a"), (two, "b"))])


def cached_offsets(spark: SparkSession, root: str, fingerprint: tuple, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(tokens with their offsets, whether they came from the cache).

    The table stands under a path that names the corpus by its content; a folder counts only
    with the writer's success mark, so a broken run leaves nothing to reuse.  ``make`` builds the
    table where there is none yet; a hit never calls it, so the texts aren't tokenised again.
    """
    path = f"{root.rstrip('/')}/offsets-" + "-".join(str(x).replace("-", "m") for x in fingerprint)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    hit = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not hit:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit
