"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text becomes the set of its distinct word shingles (64-bit hashes). Texts with equal sets
   are one class, collapsed by a 128-bit signature of the set before anything else; its smallest
   document id stands for the class. The ``k`` smallest hashes of a set are its sketch.
2. Inverted lists: each class enters the lists of some of its retained values. Two sets of the
   wanted similarity share at least ``t`` retained values, so it is enough to enter the
   ``size - t + 1`` rarest (rarest first, in one order for all). ``t`` is exact for sets that fit
   into their sketch; for larger ones it lies ``SIGMAS`` standard deviations under the expectation.
3. Full sets are made of the classes that share a list with another, and put in order: what only one of
   them has can't overlap and goes, the rest stands rarest first. The mean frequency of a set's
   shingles says how central it is (the origin of a family of copies is the most central of them).
4. Each list elects its most central class and offers a pair with it for every other class of
   the list: as many pairs as entries, however long a list is.
5. The sketch of the union of a pair (the ``k`` smallest values of both sketches) estimates the
   similarity and drops clear misses; the exact Jaccard on full sets verifies the others.
6. Lists whose classes have not all met in one component stay open. Their classes are joined again
   on the rarest shingles of their full sets, across components only, under the bound that the
   places of the common shingle leave on the overlap. This step is exact and needs no sketch. Lists are cut by
   size, and what no member of a fitting list allows goes before pairs are formed.
7. Connected components of all verified links.

Null ids are linked with nothing (component null, kept). Null or empty texts and texts without a
word have no shingles and are linked with nothing. Rows that share an id are one document, linked
where any of its texts is: they stay or go together. An empty table gives an empty result; other columns are not read.
Ties of the most central class go to the larger id, which changes which links are tried first and no component. Very long texts have large sets, which
travel as one row each; their sketches are as small as others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytewords as B
from tessera.llm.shared import components, written

SKETCH = 64
SIGMAS = 5.5


def row_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For each block of rows its bounds and the sorted distinct shingles of each row."""
    buf, offsets = B.text_bytes(texts)
    for i, j in B.blocks(offsets):
        part, at = B.LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = B.word_spans(part, at)
        shingles, to = B.shingles(B.span_hashes(part, starts, ends), first, words)
        sets = []
        for a, b in zip(to[:-1], to[1:]):
            s = np.sort(shingles[a:b].view(np.int64))  # in signed order, as Spark's
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        yield i, j, sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def sketches(docs: DataFrame, key: str, text: str, words: int, k: int) -> DataFrame:
    """Of each row: id, set size n, signature (s1, s2), sketch (the k smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in row_sets(batch.column(1), words):
                with np.errstate(over="ignore"):
                    one = np.array([s.sum() for s in sets], dtype=np.int64)
                    two = np.array([B.mix(s.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64).sum() for s in sets], dtype=np.int64)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two),
                                       _lists([s[:k] for s in sets])], names=["id", "n", "s1", "s2", "sketch"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "s1", "s2")],
                           T.StructField("sketch", T.ArrayType(T.LongType()))])
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in row_sets(batch.column(1), words):
                total = pa.array([int(s.sum()) for s in sets], pa.int64())
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), total, _lists(sets)], names=["id", "n", "s1", "shingles"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def least_shared(n: str, k: int, percent: int) -> str:
    """SQL: retained values that a set of size ``n`` shares with any set of the wanted similarity."""
    p = percent / 100
    union = f"greatest({n} / {p}, {k + 1})"  # of two such sets at most
    spread = f"{SIGMAS} * sqrt({k * p * (1 - p)} * ({union} - {k}) / ({union} - 1))"
    whole = f"(({percent} * {n} + 99) div 100)"
    return f"greatest(1, cast(case when {n} * 100 <= {percent * k} then {whole} else floor(least({p} * least({n}, {k}), {p * k} - {spread})) end as int))"


def _in_order(sets: DataFrame) -> DataFrame:
    """(id, n, central, shingles): of each set the shingles that another set has too, rarest first, and
    the mean frequency of all its shingles."""
    tokens = sets.select("id", "n", "s1", F.explode("shingles").alias("h"))
    often = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    order = tokens.join(often, "h").groupBy("id", "n", "s1").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"), F.sum("df").alias("sum"))
    return order.select("id", "n", (F.col("sum") / F.col("n")).alias("central"), F.col("s.h").alias("shingles"))


def _verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = ordered.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = ordered.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b")
    return full.withColumn("both", F.size(F.array_intersect("sa", "sb"))).where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each list's most central class with every other of a fitting size, once."""
    leaders = lists.groupBy("v").agg(F.max(F.struct("central", "id", "n")).alias("top"))
    pairs = lists.join(leaders.select("v", "top"), "v").where(f"id <> top.id and 100 * least(n, top.n) >= {percent} * greatest(n, top.n)")
    return pairs.groupBy(F.col("top.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("overlap"))


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Drop pairs whose union sketch says that the similarity is too low."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    d = pairs.join(left, "a").join(right, "b")
    d = d.withColumn("joint", F.slice(F.array_sort(F.array_union("ka", "kb")), 1, k))
    d = d.withColumn("shared", F.expr("size(array_intersect(joint, array_intersect(ka, kb)))"))
    return d.where(f"shared >= least({least_shared('na', k, percent)}, {least_shared('nb', k, percent)})").select("a", "b")


def _open_pairs(spark: SparkSession, open_sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that the places of a common rare shingle allow; exact.

    ``open_sets``: id, n, component, shingles in order. What a set has alone stands before the shared ones.
    """
    alone = "(n - size(shingles))"
    prefix = open_sets.select("id", "n", "component", F.expr(f"cast({alone} as int)").alias("alone"), F.posexplode(F.expr(
        f"slice(shingles, 1, greatest(0, cast(n - ({percent} * n + 99) div 100 + 1 - {alone} as int)))")).alias("i", "h"))
    prefix = written(spark, prefix.select("id", "n", "component", "h", (F.col("alone") + F.col("i")).alias("place")), "prefix")
    largest = prefix.groupBy("h", "component").agg(F.count("*").alias("c")).groupBy("h").agg(
        F.max_by("component", F.struct("c", "component")).alias("largest"), F.count("*").alias("components")).where("components > 1").select("h", "largest")
    # the places allow a pair where the size of each is within what the other's place leaves it ("cap"); lists are cut by
    # size, and rows go that no row of the fitting lists allows, so a long list of texts that share too little forms no pairs
    size = f"cast(floor(ln(n) / {math.log(100 / percent)}) as int)"
    cap = f"cast({100 + percent} * (n - place) div {percent} - n as bigint)"
    some = written(spark, prefix.join(largest, "h").withColumns({"cap": F.expr(cap), "g": F.expr(size)}), "open")
    first, last = f"(({percent} * n + 99) div 100)", f"least(100 * n div {percent}, cap)"
    reach = F.explode(F.expr(f"sequence({size.replace('ln(n)', f'ln({first})')}, {size.replace('ln(n)', f'ln({last})')})"))
    x = some.where(f"component <> largest and {last} >= {first}").select("h", "id", "n", "component", "cap", reach.alias("g"))

    def allowed(rows: DataFrame, by: DataFrame) -> DataFrame:
        of = by.groupBy("h", "g").agg(F.min("n").alias("least"), F.max("cap").alias("most"))
        return rows.join(of, ["h", "g"]).where("cap >= least and n <= most").drop("least", "most")

    x = allowed(x, some)
    y = allowed(some.select("h", "id", "n", "component", "cap", "g"), x)
    x, y = (d.select("h", "g", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "component", "cap")]) for d, side in ((x, "a"), (y, "b")))
    return x.join(y, ["h", "g"]).where(f"""component_a <> component_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and n_b <= cap_a and n_a <= cap_b
        """).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                    k: int = SKETCH) -> DataFrame:
    """Of each row: key, ``n_shingles``, ``component_id`` (smallest id reachable over links of at least
    ``percent`` per cent similarity, its own included), ``kept`` (it is that id)."""
    B.batch_rows(spark)
    rows = written(spark, sketches(docs, key, text, words, k), "sketches")
    some = rows.where("n > 0 and id is not null")
    classes = written(spark, some.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "classes")

    values = classes.select("id", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(often, "v").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    enter = f"greatest(0, least(n, {k}) - {least_shared('n', k, percent)} + 1 - (least(n, {k}) - size(shared)))"
    entries = written(spark, ranked.select("id", "n", F.explode(F.expr(f"slice(transform(shared, x -> x.v), 1, cast({enter} as int))")).alias("v")), "entries")
    lists = entries.join(entries.groupBy("v").agg(F.count("*").alias("size")).where("size > 1"), "v").select("id", "n", "v")
    lists = written(spark, lists, "lists")

    members = lists.select("id").distinct()
    chosen = docs.join(members.withColumnRenamed("id", key), key, "left_semi")
    ordered = written(spark, _in_order(full_sets(chosen, key, text, words)), "ordered")

    central = lists.join(ordered.select("id", "n", "central"), ["id", "n"])
    links = written(spark, _verified(_estimated(_leader_pairs(central, percent), classes, k, percent), ordered, percent), "links")
    met = components(spark, links).withColumnRenamed("node", "id")
    at = lists.join(met, "id", "left").withColumn("component", F.coalesce("component", "id"))
    still = at.groupBy("v").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("v")
    open_ids = at.join(still, "v", "left_semi").select("id", "component").distinct()
    more = _verified(_open_pairs(spark, ordered.join(open_ids, "id"), percent), ordered, percent)
    found = components(spark, links.union(more)).withColumnRenamed("node", "id")

    of_class = classes.select("s1", "s2", "n", "id").join(found, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return (out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))
