"""Near-duplicate vectors: product quantisation over coarse inverted lists, exact cosine at the end.

1. Equal vectors are one class, found by a 128-bit hash of the whole array; its smallest id stands for it.
2. The index is fitted on a bounded sample (``SAMPLE`` classes of smallest hash at most): coarse centroids of unit vectors and, for
   the residuals, a codebook for each of ``SUBSPACES`` subspaces. Every class enters the list of its nearest
   centroid with the code of its residual and the length ``err`` of what the code leaves out.
3. Probes. Let ``r`` be the largest distance of unit vectors that are linked. If two linked vectors lie in different lists, their
   distances to the plane between the two centroids add up to at most ``r``, so the nearer one visits the other's list when it goes
   to all lists within ``r / 2`` of its own border. That bound is exact but rarely met: along one direction a difference
   of length ``r`` has a standard deviation of ``r / sqrt(dims)``, and ``sigmas`` of those are the default reach. ``sigmas=None``
   takes ``r / 2`` and loses nothing. Where both vectors visit, the visit to the list of larger number counts.
4. In a list, visitors meet the members by table look-ups: a visitor's squared distances to all code words, once, then
   one look-up for each subspace and member. By the triangle inequality ``look-up distance - err`` is at most the true distance,
   so what is dropped can't be linked; what is left is compared exactly, in double precision.
5. Long lists are dealt to units of at most about ``BLOCK`` members and ``VISITORS`` visitors by hash; a unit is a
   stream of visitors past one block in memory, and returns at most a row for each vector in it: how many
   rows it is linked with, and a representative that it is connected to. No pair leaves a unit.
6. Connected components of those rows' edges.

Null ids, and vectors that are null, empty, zero or hold null or non-finite components, are linked with nothing (component: their own
id). Vectors of different lengths are never linked; each length has an index of its own. Rows that share an id are one document:
linked where any of its vectors is. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import components, written

COSINE, SIGMAS = 0.95, 4.0
LIST_ROWS, MAX_LISTS = 400, 4096
SAMPLE = 65_536
SUBSPACES, WORDS = 8, 256
BLOCK, VISITORS = 1024, 16_384
STEP, PAIRS = 256, 32_768  # visitors looked up together; pairs compared together


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        of = np.concatenate([(((c * c).sum(axis=1) - 2 * (x[i : i + 4096] @ c.T))).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(of, minlength=len(c))
        total = np.stack([np.bincount(of, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(c.dtype)
    return c


@dataclass
class Index:
    """Coarse centroids, the columns of each subspace, and its code words."""

    coarse: np.ndarray
    spaces: list[np.ndarray]
    words: list[np.ndarray]
    reach: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, radius: float, sigmas: float | None) -> Index:
        u = units(sample).astype(np.float32)
        dims = u.shape[1]
        coarse = k_means(u, lists)
        rest = u - coarse[(((coarse * coarse).sum(axis=1) - 2 * (u @ coarse.T))).argmin(axis=1)]
        spaces = np.array_split(np.arange(dims), min(SUBSPACES, dims))
        words = [k_means(np.ascontiguousarray(rest[:, s]), WORDS) for s in spaces]
        reach = radius / 2 if sigmas is None else min(radius / 2, sigmas * radius / math.sqrt(dims) / 2)
        return cls(coarse, spaces, words, reach)

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each unit vector its list, code, what the code leaves out, and the lists that it visits."""
        u = u.astype(np.float32)
        d = (self.coarse * self.coarse).sum(axis=1) - 2 * (u @ self.coarse.T)
        own = d.argmin(axis=1)
        between = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(axis=2) if len(self.coarse) <= 256 else
                                     (self.coarse**2).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * self.coarse @ self.coarse.T, 0))
        margin = (d - d[np.arange(len(u)), own][:, None]) - 2 * np.float32(self.reach * (1 + 1e-4)) * between[own]
        margin[np.arange(len(u)), own] = 1
        visits = [np.flatnonzero(m <= 1e-6) for m in margin]
        rest = u - self.coarse[own]
        code, left = np.empty((len(u), len(self.spaces)), np.uint8), np.zeros(len(u))
        for m, (s, w) in enumerate(zip(self.spaces, self.words)):
            part = rest[:, s]
            code[:, m] = ((w * w).sum(axis=1) - 2 * (part @ w.T)).argmin(axis=1)
            left += ((part - w[code[:, m]]) ** 2).sum(axis=1)
        return own, code, np.sqrt(left), visits

    def tables(self, u: np.ndarray, at: int) -> np.ndarray:
        """(visitor, subspace, word): squared distances of the visitors' residuals in list ``at`` to all code words."""
        rest = u.astype(np.float32) - self.coarse[at]
        out = np.full((len(u), len(self.spaces), WORDS), np.inf, np.float32)
        for m, (s, w) in enumerate(zip(self.spaces, self.words)):
            part = rest[:, s]
            out[:, m, : len(w)] = np.maximum((part * part).sum(axis=1)[:, None] + (w * w).sum(axis=1) - 2 * (part @ w.T), 0)
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Unit:
    """One block of a list's members, and what the visitors past it add up to."""

    def __init__(self, index: Index, at: int, cosine: float):
        self.index, self.at, self.cosine = index, at, cosine
        self.radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-4
        self.batches: list[dict] = []
        self.ready = False

    def member(self, rows: dict) -> None:
        self.batches.append(rows)

    def _seal(self) -> None:
        m = {c: np.concatenate([b[c] for b in self.batches]) for c in ("id", "h", "n", "x", "norm", "code", "err")}
        visits = [v for b in self.batches for v in b["visits"]]
        self.goes = np.zeros((len(m["id"]), len(self.index.coarse)), dtype=bool)
        for i, v in enumerate(visits):
            self.goes[i, v] = True
        self.m, self.label, self.count = m, np.arange(len(m["id"])), np.zeros(len(m["id"]), np.int64)
        self.cut = ((self.radius + m["err"] + 1e-4) ** 2).astype(np.float32)
        self.ready = True

    def visit(self, v: dict) -> tuple[np.ndarray, ...] | None:
        """(id, h, links, representative) of the visitors that are linked with a member."""
        if not self.batches:
            return None
        if not self.ready:
            self._seal()
        m, home = self.m, v["list"] == self.at
        tables = self.index.tables(units(v["x"]), self.at)
        look = np.zeros((len(v["id"]), len(m["id"])), np.float32)
        for s in range(tables.shape[1]):
            look += tables[:, s, :][:, m["code"][:, s]]
        near = look <= self.cut
        both = self.goes[:, v["list"]].T & (v["list"] > self.at)[:, None]  # the member's visit counts that pair
        near &= ~both
        one, two = np.nonzero(near)
        same = home[one] & (v["block"][one] == v["at_block"][one])  # each pair of one block twice: once is enough
        ordered = (v["h"][one] > m["h"][two]) | ((v["h"][one] == m["h"][two]) & (v["id"][one] > m["id"][two]))
        some = ~same | ordered
        one, two = one[some], two[some]
        linked = np.zeros(len(one), dtype=bool)
        for i in range(0, len(one), PAIRS):
            a, b = one[i : i + PAIRS], two[i : i + PAIRS]
            linked[i : i + PAIRS] = np.einsum("ij,ij->i", v["x"][a], m["x"][b]) / (v["norm"][a] * m["norm"][b]) >= self.cosine
        one, two = one[linked], two[linked]
        if not len(one):
            return None
        links = np.bincount(one, weights=m["n"][two], minlength=len(v["id"])).astype(np.int64)
        self.count += np.bincount(two, weights=v["n"][one], minlength=len(m["id"])).astype(np.int64)
        while True:
            least = np.full(len(v["id"]), len(m["id"]))
            np.minimum.at(least, one, self.label[two])
            new = self.label.copy()
            np.minimum.at(new, two, least[one])
            to = np.arange(len(new))
            np.minimum.at(to, self.label, new)
            new = to[new]
            if (new == self.label).all():
                break
            self.label = new
        found = np.flatnonzero(links)
        return v["id"][found], v["h"][found], links[found], m["id"][least[found]]

    def members(self) -> tuple[np.ndarray, ...] | None:
        if not self.ready or not self.count.any():
            return None
        some = np.flatnonzero(self.count)
        return self.m["id"][some], self.m["h"][some], self.count[some], self.m["id"][self.label[some]]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors whose squares could leave the range of doubles, by a power of two."""
    most = np.abs(x).max(axis=1, initial=0)
    far = (most > 1e150) | (most < 1e-150)
    if far.any():
        x[far] *= np.exp2(-np.floor(np.log2(most[far])))[:, None]
    return x


def _of_length(spark: SparkSession, classes: DataFrame, dims: int, count: int, cosine: float, sigmas: float | None, list_rows: int) -> DataFrame:
    """(id, h, links, rep) of the classes with ``dims`` components, several rows a class."""
    lists = max(1, min(MAX_LISTS, round(count / list_rows)))
    sample = classes.orderBy("h", "id").select("v").limit(min(SAMPLE, max(4096, 16 * lists))).collect()  # bounded by SAMPLE
    index = Index.fit(_scaled(np.array([r.v for r in sample], dtype=np.float64)), lists, math.sqrt(max(0.0, 2 - 2 * cosine)), sigmas)
    shared = spark.sparkContext.broadcast(index)  # MAX_LISTS vectors and the code words

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i in range(0, len(batch), STEP):
                part = batch.slice(i, STEP)
                own, code, err, visits = index.place(units(_scaled(_vectors(part.column("v")))))
                yield pa.record_batch([*part.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err),
                                       pa.array([x.astype(np.int32) for x in visits], pa.list_(pa.int32()))], names=[*part.schema.names, "list", "code", "err", "visits"])

    extra = [T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("err", T.DoubleType()), T.StructField("visits", T.ArrayType(T.IntegerType()))]
    entries = written(spark, classes.mapInArrow(place, T.StructType([*classes.schema.fields, *extra])), "entries")

    members = entries.groupBy("list").agg(F.count("*").alias("members"))
    visitors = entries.select(F.explode("visits").alias("list")).groupBy("list").agg(F.count("*").alias("visitors"))
    sizes = members.join(visitors, "list", "left").select("list", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
                                                          F.ceil((F.col("members") + F.coalesce("visitors", F.lit(0))) / VISITORS).cast("int").alias("shares"))
    sizes = F.broadcast(written(spark, sizes, "sizes"))  # MAX_LISTS rows
    block, share = F.pmod(F.col("h"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("h", "id"), F.col("shares")).cast("int")
    common = ["id", "h", "n", "v", F.col("list").alias("home")]
    no_code, no_visits = F.lit(None).cast("binary"), F.lit(None).cast("array<int>")
    homes = entries.join(sizes, "list").withColumn("block", block)
    inside = homes.select(F.col("list").alias("at"), F.col("block").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("side"), "block",
                          *common, "code", "err", "visits")
    at_home = homes.select(F.col("list").alias("at"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("unit"), share.alias("share"), F.lit(1).alias("side"), "block", *common,
                           no_code.alias("code"), F.lit(0.0).alias("err"), no_visits.alias("visits"))
    away = (entries.select("id", "h", "n", "v", F.col("list").alias("home"), F.explode("visits").alias("list")).join(sizes, "list")
            .select(F.col("list").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("unit"), share.alias("share"), F.lit(1).alias("side"), F.lit(-1).alias("block"),
                    "id", "h", "n", "v", "home", no_code.alias("code"), F.lit(0.0).alias("err"), no_visits.alias("visits")))
    met = inside.union(at_home).union(away).repartition("at", "unit", "share").sortWithinPartitions("at", "unit", "share", "side")
    key_type = classes.schema["id"].dataType

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, unit, key = shared.value, None, None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("at", "unit", "share", "side")]
            steps = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            for a, b in zip([0, *steps], [*steps, len(batch)]):
                own = tuple(int(x[a]) for x in names[:3])
                if own != key:
                    if unit is not None and (rows := unit.members()):
                        yield _found(rows)
                    unit, key = Unit(index, own[0], cosine), own
                for i in range(a, b, STEP):
                    part = batch.slice(i, min(STEP, b - i))
                    x = _scaled(_vectors(part.column("v")))
                    rows = {"id": part.column("id").to_numpy(zero_copy_only=False), "h": part.column("h").to_numpy(), "n": part.column("n").to_numpy(), "x": x, "norm": np.sqrt((x * x).sum(axis=1)),
                            "list": part.column("home").to_numpy(), "block": part.column("block").to_numpy(), "at_block": np.full(len(part), own[1])}
                    if names[3][a] == 0:
                        rows |= {"code": np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(part), -1), "err": part.column("err").to_numpy(),
                                 "visits": [np.array(v, dtype=np.int64) for v in part.column("visits").to_pylist()]}
                        unit.member(rows)
                    elif (out := unit.visit(rows)) is not None:
                        yield _found(out)
        if unit is not None and (rows := unit.members()):
            yield _found(rows)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(key_type)

    def _found(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(rows[0], arrow), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3], arrow)], names=["id", "h", "links", "rep"])

    return met.mapInArrow(meet, T.StructType([T.StructField("id", key_type), T.StructField("h", T.LongType()), T.StructField("links", T.LongType()), T.StructField("rep", key_type)]))


def vector_duplicates(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                      sigmas: float | None = SIGMAS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Of each row: key, ``n_links`` (other rows with a vector of at least that cosine), ``component_id``, ``kept``."""
    bare = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & fine, F.lit(False))
    rows = bare.select("id", "v", usable.alias("usable"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), F.col("v")).alias("g"))
    classes = written(spark, rows.where("usable").groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")).select("id", "h", "g", "n", "v"), "classes")
    links = None
    for r in classes.groupBy(F.size("v").alias("dims")).count().orderBy("dims").collect():  # a row a length
        found = _of_length(spark, classes.where(F.size("v") == r["dims"]).select("id", "h", "n", "v"), r["dims"], r["count"], cosine, sigmas, list_rows)
        links = found if links is None else links.union(found)
    narrow = written(spark, rows.select("id", "usable", "h", "g"), "rows")
    if links is None:
        return narrow.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = written(spark, links, "links")
    counts = links.groupBy("id", "h").agg(F.sum("links").alias("links"))
    of_class = classes.select("h", "g", F.col("id").alias("class_id"), "n").join(counts.select(F.col("id").alias("class_id"), "h", "links"), ["class_id", "h"], "left")
    placed = written(spark, narrow.join(of_class, ["h", "g"], "left").select("id", "usable", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "placed")
    # ids that stand in several classes tie them together
    several = placed.where("usable").groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("id")
    edges = links.select(F.col("id").alias("a"), F.col("rep").alias("b")).union(placed.where("usable").join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("class_id").alias("b")))
    found = components(spark, edges)
    out = placed.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.when(F.col("usable"), F.coalesce("component", "class_id")).otherwise(F.col("id"))
    return (out.select(F.col("id").alias(key), F.when(F.col("usable"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))


def oracle_sql(table: str = "embeddings", cosine: float = COSINE) -> str:
    return f"""
WITH RECURSIVE fine AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v, len(embedding) AS d FROM {table}
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), 'sum') > 0),
l AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.r <> b.r AND a.d = b.d WHERE list_cosine_similarity(a.v, b.v) >= {cosine}),
n AS (SELECT r, count(*) AS n FROM l GROUP BY r),
reach AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM fine UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component, t.vec_id) AS component_id, coalesce(t.vec_id = coalesce(c.component, t.vec_id), true) AS kept
FROM {table} t LEFT JOIN fine ON fine.vec_id = t.vec_id LEFT JOIN n ON n.r = fine.r LEFT JOIN c ON c.a = t.vec_id"""
