"""Tensor tables ``(name, row_id, values ARRAY<FLOAT>)``.

Re-aimed checkpoint tooling: counting, magnitude masks, key cleaning, hybrid
merges and copy audits expressed as joins and aggregates over tensor rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Renaming from the source layout to the target layout (W8),
# applied in this order.
NAME_MAP = [
    ("embed_tokens", "embeddings"),
    ("input_layernorm", "attn_norm"),
    ("post_attention_layernorm", "mlp_norm"),
    ("self_attn.", "attn."),
]

# Default closeness tolerances by dtype (rtol, atol).
TOLERANCES = {"float32": (1.3e-6, 1e-5), "bfloat16": (1.6e-2, 1e-5)}


def parameter_table(tensors: DataFrame, frozen: list[str] = ()) -> DataFrame:
    """``(name, numel, requires_grad)`` from tensor rows (one partial aggregate); the tensors named in
    ``frozen`` aren't trained."""
    return (tensors.groupBy("name").agg(F.sum(F.size("values")).cast("long").alias("numel"))
            .withColumn("requires_grad", ~F.col("name").isin(*frozen) if frozen else F.lit(True)))


def parameter_groups(params: DataFrame, attn_rate: float, other_rate: float) -> DataFrame:
    """Per group ('attn' in name vs other) total and trainable counts, the trainable share, and the
    learning rate of its trainable parameters (null where it has none)."""
    grp = F.when(F.col("name").contains("attn"), "attn").otherwise("other")
    rate = F.when(F.col("group") == "attn", F.lit(float(attn_rate))).otherwise(F.lit(float(other_rate)))
    return (params.groupBy(grp.alias("group"))
            .agg(F.sum("numel").alias("n_params"),
                 F.sum(F.when(F.col("requires_grad"), F.col("numel")).otherwise(0)).alias("n_trainable"))
            .withColumn("trainable_share", F.col("n_trainable") / F.col("n_params"))
            .withColumn("learning_rate", F.when(F.col("n_trainable") > 0, rate))
            .withColumn("n_params_text", human_count(F.col("n_params"))))


def human_count(n: F.Column) -> F.Column:
    """Ki/Mi/Gi rendering of a count."""
    return (F.when(n >= 1 << 30, F.concat(F.format_number(n / (1 << 30), 2), F.lit("Gi")))
            .when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 2), F.lit("Mi")))
            .when(n >= 1 << 10, F.concat(F.format_number(n / (1 << 10), 2), F.lit("Ki")))
            .otherwise(n.cast("string")))


def elements(tensors: DataFrame) -> DataFrame:
    """Long form ``(name, row_id, col, w DOUBLE)``."""
    return tensors.select("name", "row_id", F.posexplode("values").alias("col", "w")) \
        .withColumn("w", F.col("w").cast("double"))


DIGIT = 11  # bits of a radix digit: a histogram has 2,048 cells
NAMES = 1000  # tensors whose histograms a task holds at once


def _digit_counts(rows: DataFrame, bits: int, done: int, width: int) -> DataFrame:
    """(name, digit, c): of each tensor the counts of the next ``width`` bits of |w| among the elements whose first
    ``done`` bits are the tensor's ``prefix``. A task sends one histogram a tensor, whatever it read."""
    kind, shift, cells = (np.uint32 if bits == 32 else np.uint64), bits - done - width, 1 << width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            some = [(n, np.flatnonzero(h), h) for n, h in total.items()]
            names = pa.array([n for n, at, _ in some for _ in at], pa.string())
            digits = np.concatenate([at for _, at, _ in some] or [np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([names, pa.array(digits, pa.int64()), pa.array(np.concatenate([h[at] for _, at, h in some] or [np.zeros(0, np.int64)]), pa.int64())],
                                              names=["name", "digit", "c"])

        for b in batches:
            names = b.column(0).dictionary_encode()
            place = names.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names.dictionary.to_pylist()):
                part = b.take(pa.array(np.flatnonzero(place == i)))
                u = np.abs(part.column(1).flatten().drop_null().to_numpy()).view(kind)  # bits of |w| stand in its order, NaN last
                if done:
                    u = u[u >> kind(shift + width) == kind(part.column(2)[0].as_py())]
                if name not in total and len(total) >= NAMES:
                    yield out()
                    total.clear()
                h = np.bincount((u >> kind(shift) & kind(cells - 1)).astype(np.int64), minlength=cells)
                total[name] = total.get(name, 0) + h
        yield out()

    return rows.mapInArrow(run, "name string, digit long, c long").groupBy("name", "digit").agg(F.sum("c").alias("c"))


def magnitude_threshold(tensors: DataFrame, sparsity: float) -> DataFrame:
    """Per tensor ``k = floor(n * sparsity)`` and the exact k-th smallest |w|.

    Radix selection on the bits of |w|, which stand in the order of the values: a pass counts the next digit of
    the elements that share the digits found so far (fixed-size histograms, one a task and tensor), and the digit that holds rank
    k is kept. 32-bit floats take three passes over the rows, doubles six; elements never become rows and never move, so
    ties, zeros, outliers and very long tensors cost the same. NaN counts as largest; null elements don't count.
    Output ``name, n, k, threshold`` (threshold null when k = 0: keep everything).
    """
    spark = tensors.sparkSession
    rows = tensors.where("name is not null").select("name", "values")
    bits = 32 if rows.schema["values"].dataType.elementType.typeName() == "float" else 64
    if bits == 64:
        rows = rows.withColumn("values", F.col("values").cast("array<double>"))
    state, done = None, 0
    while done < bits:
        width = min(DIGIT, bits - done)
        # one row a tensor is sent to the tasks
        here = rows.withColumn("prefix", F.lit(0).cast("long")) if state is None else rows.join(F.broadcast(state.where("k > 0").select("name", "prefix")), "name")
        counts = _digit_counts(here, bits, done, width)
        by = Window.partitionBy("name").orderBy("digit")  # at most 2,048 rows a tensor
        if state is None:
            first = written(spark, counts, "digits")
            state = first.groupBy("name").agg(F.sum("c").alias("n")).withColumn("k", F.floor(F.col("n") * F.lit(float(sparsity))).cast("long"))
            state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("rank", F.col("k"))
            counts = first
        held = counts.join(state, "name").withColumn("upto", F.sum("c").over(by)).where("rank > upto - c and rank <= upto")
        held = held.select("name", (F.col("prefix") * (1 << width) + F.col("digit")).alias("_prefix"), (F.col("rank") - F.col("upto") + F.col("c")).alias("_rank"))
        state = written(spark, state.join(held, "name", "left").select("name", "n", "k", F.col("_prefix").alias("prefix"), F.col("_rank").alias("rank")), "ranks")
        done += width

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(3).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32 if bits == 32 else np.uint64)
            v = u.view(np.float32 if bits == 32 else np.float64).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(v, mask=b.column(3).is_null().to_numpy(zero_copy_only=False))], names=["name", "n", "k", "threshold"])

    return state.select("name", "n", "k", "prefix").mapInArrow(value, "name string, n long, k long, threshold double")


def apply_mask(tensors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Keep |w| strictly above the threshold (ties pruned too); masked
    value = w where kept else 0.  Adds ``mask ARRAY<BOOLEAN>`` and ``masked``."""
    t = tensors.join(thresholds.select("name", "threshold"), "name", "left")
    keep = lambda x: F.col("threshold").isNull() | (F.abs(x.cast("double")) > F.col("threshold"))
    return t.withColumn("mask", F.transform("values", keep)) \
        .withColumn("masked", F.transform("values", lambda x: F.when(keep(x), x).otherwise(F.lit(0.0).cast("float"))))


def achieved_sparsity(masked: DataFrame) -> DataFrame:
    """Pruned / n per tensor and the sum of masked values."""
    pruned = F.size(F.filter("mask", lambda m: ~m))
    return masked.groupBy("name").agg(
        (F.sum(pruned) / F.sum(F.size("mask"))).alias("achieved_sparsity"),
        F.sum(F.aggregate("masked", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("masked_sum"))


def clean_keys(df: DataFrame, col: str = "key") -> DataFrame:
    """Strip leading wrapper prefixes, drop teacher-attention rows, remove
    ``.student_attn`` from the key (anchored prefix strip, see SURVEY decision)."""
    k = F.regexp_replace(F.col(col), r"^(_forward_module\.|module\.)+", "")
    return (df.withColumn(col, k).filter(~F.col(col).contains(".teacher_attn"))
            .withColumn(col, F.regexp_replace(F.col(col), r"\.student_attn", "")))


def layer_of(name: F.Column) -> F.Column:
    return F.regexp_extract(name, r"^model\.layers\.(\d+)\.", 1).try_cast("int")


def hybrid_merge(teacher: DataFrame, student: DataFrame, keep_layers: DataFrame) -> DataFrame:
    """All attention tensors (incl. norms named attn) of kept layers come from
    the teacher, whichever the student has there; everything else from the student.
    ``keep_layers`` is a one-column table ``layer`` (one row per layer of the model: broadcast)."""
    kept = F.broadcast(keep_layers.select("layer", F.lit(True).alias("kept")).distinct())
    is_attn = F.col("name").contains("attn")

    def marked(df: DataFrame) -> DataFrame:
        return (df.withColumn("layer", layer_of(F.col("name"))).join(kept, "layer", "left")
                .withColumn("_kept", F.coalesce("kept", F.lit(False)) & is_attn).drop("layer", "kept"))

    t = marked(teacher).filter("_kept").withColumn("source", F.lit("teacher"))
    s = marked(student).filter("not _kept").withColumn("source", F.lit("student"))
    return t.unionByName(s).drop("_kept")


def missing_keys(merged: DataFrame, expected: DataFrame) -> DataFrame:
    """W5 report: expected tensor names absent from the merge."""
    return expected.select("name").distinct().join(merged.select("name").distinct(), "name", "left_anti")


def repeat_rows(tensors: DataFrame, groups: int) -> DataFrame:
    """Row r -> rows r*g .. r*g+g-1 (single rows repeated, not head blocks)."""
    return tensors.select("name", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("j"), "row_id", "values") \
        .select("name", (F.col("row_id") * groups + F.col("j")).alias("row_id"), F.col("row_id").alias("src_row"), "values")


def truncate_tensor(tensors: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """First ``n_rows`` rows and/or first ``n_cols`` columns."""
    out = tensors
    if n_rows is not None:
        out = out.filter(F.col("row_id") < n_rows)
    if n_cols is not None:
        out = out.withColumn("values", F.slice("values", 1, n_cols))
    return out


def map_name(c: F.Column) -> F.Column:
    for a, b in NAME_MAP:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


FEW_ROWS = 1_000_000


def parity_audit(source: DataFrame, target: DataFrame, rtol: float, atol: float) -> DataFrame:
    """Join source (renamed) and target rows; per tensor max |diff|, number
    of elements outside ``atol + rtol*|target|``, missing and extra rows.

    Digests (128 bits) of the rows are joined first; rows of equal digests differ by nothing and their values stay where they
    are. Values are fetched only for the others, and for rows with a NaN, which equals nothing (equal infinities do). The
    list of those is sent to the scans while it has at most ``FEW_ROWS`` rows; a longer one is joined.
    """
    spark = source.sparkSession
    s = source.select(map_name(F.col("name")).alias("name"), "row_id", F.col("values").alias("v"))
    t = target.select("name", "row_id", F.col("values").alias("v"))

    def digests(df: DataFrame, side: str) -> DataFrame:
        odd = F.exists("v", lambda x: F.isnan(x.cast("double")))
        return df.select("name", "row_id", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), F.size("v").alias("n"), F.coalesce(odd, F.lit(True)).alias("odd")).alias(side))

    path = written(spark, digests(s, "s").join(digests(t, "t"), ["name", "row_id"], "full_outer"), "digests")
    unequal = path.where("s is not null and t is not null and (s <> t or s.odd)").select("name", "row_id")
    if unequal.count() <= FEW_ROWS:
        unequal = F.broadcast(unequal)  # counted
    one, two = (df.join(unequal, ["name", "row_id"], "left_semi").withColumnRenamed("v", v) for df, v in ((s, "sv"), (t, "tv")))
    nan = lambda a, b: F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    apart = lambda a, b: F.when(~nan(a, b) & (a == b), 0.0).otherwise(F.abs(a.cast("double") - b.cast("double")))
    diffs = F.zip_with("sv", "tv", apart)
    bad = F.zip_with("sv", "tv", lambda a, b: nan(a, b) | (apart(a, b) > F.lit(atol) + F.lit(rtol) * F.abs(b.cast("double"))))
    fetched = one.join(two, ["name", "row_id"]).select("name", F.array_max(diffs).alias("d"), F.size(F.filter(bad, lambda x: x)).alias("m"))
    far = fetched.groupBy("name").agg(F.max("d").alias("d"), F.sum("m").alias("m"))
    missing, extra = F.col("t").isNull(), F.col("s").isNull()
    rows = path.groupBy("name").agg(F.max(F.when(~missing & ~extra & (F.col("s.n") > 0), 0.0)).alias("zero"), F.sum(F.when(missing, 1).otherwise(0)).alias("missing_rows"),
                                    F.sum(F.when(extra, 1).otherwise(0)).alias("extra_rows"))
    # nulls give way to numbers in greatest
    return rows.join(far, "name", "left").select("name", F.greatest("zero", "d").alias("max_abs_diff"), F.coalesce("m", F.lit(0).cast("long")).alias("n_mismatch"), "missing_rows", "extra_rows")
