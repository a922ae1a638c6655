"""Centroid clustering of integer vectors, with an N-simplex projection as filter.

Each component x of a vector becomes the integer ``floor(scale * x)``. Centroids start as the ``k`` vectors of smallest
``sha256("1:<id>")``; each of ``rounds`` rounds assigns every vector to its nearest centroid (squared Euclidean distance,
ties to the smaller number) and replaces each centroid that has vectors by the exact floor of their mean; then
vectors are assigned once more.

N-simplex projection: ``pivots`` vectors span a simplex. The distances of a vector to the pivots, computed once
and written with it, fix an apex over that simplex: coordinates in the space of the pivots and an altitude over it. For two
apexes the Euclidean distance is a lower bound of the true distance, and with one altitude turned over it is an upper
bound. A centroid whose lower bound exceeds the least upper bound can't be nearest; only the others are compared,
by exact integers. Bounds are widened by ``SLACK`` of the largest distance, far above rounding error, so the filter never decides.

A pass sends ``k`` centroids and apexes to the tasks and gets one partial sum a task, cluster and component
back through Spark's sums; nothing else leaves a task. Values and sums that leave the range of fast integers (some
component of 2**24 or more) are compared and added exactly as Python integers, in limbs of 24 bits.

Kept are vectors with exactly ``dims`` components, none null or non-finite; others give no row. Null ids are clustered
but start no centroid. Rows that share an id, or are equal, count one by one; of rows with the same hash the least vector
starts first. With fewer than ``k`` vectors there are fewer centroids; an empty table gives an empty result.
A distance or inertia beyond a long is null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import written

K, DIMS, SCALE, ROUNDS, PIVOTS = 16, 64, 64, 3, 8
FAST, LIMB = 1 << 24, 24
FLAT = 0.1  # a pivot's least altitude over those before it, by its largest distance to them
SLACK = 1e-3
MOST = (1 << 63) - 1


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers where all are small, else Python integers."""
    if not x.size or np.abs(x).max() < FAST / scale:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    for at, v in np.ndenumerate(x):
        a, b = float(v).as_integer_ratio()
        out[at] = a * scale // b
    return out


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``v`` to rows of ``c`` of the same number."""
    d = v - c
    return (d * d).sum(axis=1)


def floats(v: np.ndarray) -> np.ndarray:
    """Integers as doubles; infinite where they are too large for one."""
    if v.dtype == object:
        v = np.array([x if abs(x) < 1 << 1000 else np.inf for x in v.ravel()], dtype=np.float64).reshape(v.shape)
    return v.astype(np.float64)


class Simplex:
    """The pivots' simplex: each row of ``base`` is a pivot's coordinates, the first at the origin."""

    def __init__(self, pivots: np.ndarray):
        """Pivots that lie in the space of those before them are left out."""
        self.pivots, rows = [], []
        for p in pivots:
            if not (np.abs(p) < 1e100).all():
                continue
            if not self.pivots:
                self.pivots, rows = [p], [np.zeros(0)]
                continue
            d = np.sqrt(((np.array(self.pivots) - p) ** 2).sum(axis=1))
            at = self._apex(d[None], rows)[0]
            if at[-1] > FLAT * max(1.0, d.max()):
                self.pivots.append(p)
                rows.append(at)
        self.rows, self.pivots = rows, np.array(self.pivots)

    @staticmethod
    def _apex(d: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Coordinates of points by their distances ``d`` to the pivots; the altitude is last."""
        n, m = d.shape
        out, left = np.zeros((n, m)), d[:, 0] ** 2
        for i in range(1, m):
            b = rows[i]  # i coordinates, the last one not zero
            norm = (b**2).sum()
            out[:, i - 1] = (d[:, 0] ** 2 + norm - d[:, i] ** 2 - 2 * out[:, : i - 1] @ b[: i - 1]) / (2 * b[i - 1])
            left = left - out[:, i - 1] ** 2
        out[:, m - 1] = np.sqrt(np.maximum(left, 0))
        return out

    def apexes(self, v: np.ndarray) -> np.ndarray:
        if not len(self.pivots):
            return np.zeros((len(v), 0))
        with np.errstate(over="ignore", invalid="ignore"):
            return self._apex(np.sqrt(((floats(v)[:, None, :] - self.pivots) ** 2).sum(axis=2)), self.rows)


def bounds(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all apexes ``a`` to all apexes ``c``."""
    flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
    down, up = (a[:, None, -1] - c[None, :, -1]) ** 2, (a[:, None, -1] + c[None, :, -1]) ** 2
    return np.sqrt(flat + down), np.sqrt(flat + up)


def nearest(v: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid and its exact squared distance; and how many exact distances that took."""
    if len(apexes) and np.isfinite(apexes).all() and np.isfinite(of_centroids).all():
        lower, upper = bounds(apexes, of_centroids)
        least = upper.min(axis=1)
        open_ = lower <= (least * (1 + SLACK) + SLACK * (1 + np.abs(apexes).max() + np.abs(of_centroids).max()))[:, None]
    else:
        open_ = np.ones((len(v), len(centroids)), dtype=bool)  # beyond the range of doubles
    best, cluster = np.full(len(v), -1, dtype=v.dtype), np.zeros(len(v), dtype=np.int64)
    for j in range(len(centroids)):  # in order, so a tie stays with the smaller number
        some = np.flatnonzero(open_[:, j])
        d = squared(v[some], centroids[j])
        better = (best[some] < 0) | (d < best[some])
        cluster[some[better]], best[some[better]] = j, d[better]
    return cluster, best, int(open_.sum())


def limbs(v: int) -> list[int]:
    """The 24-bit limbs of an integer, each with its sign."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & (FAST - 1)))
        v >>= LIMB
    return out


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a, dtype="<f8")
    return pa.array([r.tobytes() for r in a], pa.binary())


def kept_vectors(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, v) of the rows that are clustered."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dims) & F.coalesce(fine, F.lit(False)))


def _assign(rows: DataFrame, simplex, centroids: list, scale: int, sums: bool) -> DataFrame:
    """Of each row its cluster and distance, or, with ``sums``, what each task adds up of its clusters."""
    shared = rows.sparkSession.sparkContext.broadcast((simplex, centroids))  # k vectors and the pivots

    def batches_of(batches: Iterator[pa.RecordBatch]):
        simplex, centroids = shared.value
        small = max((abs(x) for c in centroids for x in c), default=0) < FAST
        c = np.array([np.array(x, dtype=np.int64 if small else object) for x in centroids])
        of_centroids = simplex.apexes(c)
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                v = integers(_arrays(part.column(1)), scale)
                apexes = np.frombuffer(b"".join(part.column(2).to_pylist()), "<f8").reshape(len(v), -1)
                if v.dtype == object or not small:
                    v = v.astype(object)
                yield part, v, *nearest(v, apexes, c.astype(v.dtype), of_centroids)[:2]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, cluster, distance in batches_of(batches):
            d = pa.array([int(x) if x <= MOST else None for x in distance], pa.int64()) if v.dtype == object else pa.array(distance)
            exact = [limbs(int(x)) for x in distance] if v.dtype == object else [None] * len(v)
            yield pa.record_batch([part.column(0), pa.array(cluster.astype(np.int32)), d, pa.array(exact, pa.list_(pa.int64()))], names=["id", "cluster", "distance", "limbs"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, v, cluster, _ in batches_of(batches):
            for j in np.unique(cluster):
                own = v[cluster == j]
                n, s = total.get(int(j), (0, 0))
                total[int(j)] = n + len(own), s + own.sum(axis=0).astype(object)
        out = [(j, c, i, x, n) for j, (n, s) in total.items() for c, value in enumerate(s) for i, x in enumerate(limbs(int(value)) or [0])]
        yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["cluster", "at", "limb", "value", "n"])

    if sums:
        return rows.mapInArrow(added, "cluster long, at long, limb long, value long, n long").groupBy("cluster", "at", "limb").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    return rows.mapInArrow(assigned, T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("limbs", T.ArrayType(T.LongType()))]))


def fitted(spark: SparkSession, kept: DataFrame, k: int, scale: int, rounds: int, pivots: int) -> tuple[DataFrame, Simplex, list[list[int]]]:
    """The kept rows with their apexes (id, v, apex), the simplex and the final centroids."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = kept.where("id is not null").select(order.alias("_h"), "v").orderBy("_h", "v").limit(max(k, pivots)).collect()
    centroids = [[int(x) for x in integers(np.array([r.v]), scale)[0]] for r in first[:k]]
    simplex = Simplex(np.array([floats(integers(np.array([r.v]), scale))[0] for r in first[:pivots]]))
    shared = spark.sparkContext.broadcast(simplex)

    def apexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                yield pa.record_batch([part.column(0), part.column(1), _binary(shared.value.apexes(integers(_arrays(part.column(1)), scale)))], names=["id", "v", "apex"])

    rows = written(spark, kept.mapInArrow(apexes, T.StructType([*kept.schema.fields, T.StructField("apex", T.BinaryType())])), "apexes")
    for _ in range(rounds if centroids else 0):
        found: dict[tuple[int, int], list[int]] = {}
        for r in _assign(rows, simplex, centroids, scale, True).collect():  # k clusters, their components and limbs
            s = found.setdefault((r.cluster, r.at), [0, 0])
            s[0] += r.value << (LIMB * r.limb)
            s[1] = max(s[1], r.n)
        counts: dict[int, int] = {}
        for (j, _), (_, n) in found.items():
            counts[j] = max(counts.get(j, 0), n)
        centroids = [[found[j, c][0] // counts[j] for c in range(len(old))] if j in counts else old for j, old in enumerate(centroids)]
    return rows, simplex, centroids


def clustered(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE,
              rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """Of each kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, simplex, centroids = fitted(spark, kept_vectors(vectors, key, vector, dims), k, scale, rounds, pivots)
    if not centroids:  # only null ids, or nothing
        return rows.limit(0).select(F.col("id").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                                    F.lit("").alias("centroid_sha256"))
    out = written(spark, _assign(rows, simplex, centroids, scale, False), "clusters")
    inertia: dict[int, int] = {}
    near = out.where("limbs is null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    far = out.where("limbs is not null").select("cluster", F.posexplode("limbs").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s")).collect()
    for r in near:
        inertia[r.cluster] = inertia.get(r.cluster, 0) + int(r.s)
    for r in far:
        inertia[r.cluster] = inertia.get(r.cluster, 0) + (r.s << (LIMB * r.i))
    total = sum(inertia.values())
    fit = lambda x: x if x <= MOST else None
    table = [(j, fit(inertia.get(j, 0)), fit(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sums = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.drop("limbs").join(F.broadcast(sums), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(table: str = "embeddings", k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS) -> str:
    ctes = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE len(embedding) = {dims} AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0)""",
            f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY j < {k})"]
    dist = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT *, {dist} AS d FROM kept, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, j) = 1)")
        if r < rounds:
            ctes.append(f"""s{r} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds}"""
