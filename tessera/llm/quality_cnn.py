"""Document quality from a byte-level convolutional network, trained and applied with NumPy.

A text is cut into overlapping chunks that cover it whole. Bytes are embedded, learned filters run
over each chunk and are max-pooled there; a small layer turns a chunk's pooled filters into features,
and the mean and the maximum of these over all chunks of the text give one probability.

Training: at most ``sample`` labelled rows of each label (those with the smallest hash of the id) and
at most ``sample_chunks`` evenly spaced chunks of each reach the driver, at most
``2 * sample * sample_chunks * CHUNK`` bytes. The share of the labels, over all training rows, sets the prior.
Rows whose ``crc32(id as text) mod fold_of`` is ``fold`` are held out. Labels, language, source and id never enter a score.

A null or empty text is one chunk of padding. Without a training row of label 0 every score is 1,
without one of label 1 every score is 0. A repeated label row counts once; of contradicting labels of one id
the smaller counts. Repeated rows get equal scores; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytewords as B

CHUNK, HOP, WIDTH, STRIDE, DIM, FILTERS, FEATURES = 256, 192, 8, 2, 8, 24, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks that cover ``size`` bytes."""
    return np.arange(max(1, -(-(size - (CHUNK - HOP)) // HOP))) * HOP


def cut(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks that begin at ``begin``, filled up with zero bytes after ``end``."""
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(buf):
        return np.zeros(at.shape, dtype=np.uint8)
    return np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint8)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.w = {
            "embed": f(256, DIM, s=0.5), "filters": f(WIDTH * DIM, FILTERS, s=0.2), "filters0": np.zeros(FILTERS, np.float32),
            "features": f(FILTERS, FEATURES, s=0.3), "features0": np.zeros(FEATURES, np.float32), "out": f(2 * FEATURES, s=0.3), "out0": np.zeros(1, np.float32),
        }

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        emb = self.w["embed"][chunks].reshape(len(chunks), CHUNK * DIM)
        return np.lib.stride_tricks.sliding_window_view(emb, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]

    def pooled(self, chunks: np.ndarray, keep: bool = False):
        win = np.ascontiguousarray(self.windows(chunks)).reshape(-1, WIDTH * DIM)
        act = (win @ self.w["filters"]).reshape(len(chunks), PLACES, FILTERS)
        if not keep:
            return act.max(axis=1) + self.w["filters0"]
        best = act.argmax(axis=1)
        return np.take_along_axis(act, best[:, None], 1)[:, 0] + self.w["filters0"], best, win.reshape(len(chunks), PLACES, -1)

    def chunk_features(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(pooled, 0) @ self.w["features"] + self.w["features0"], 0)

    def logit(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        count = np.diff(np.concatenate((first, [len(feats)])))[:, None]
        both = np.concatenate((np.add.reduceat(feats, first) / count, np.maximum.reduceat(feats, first)), axis=1)
        return both @ self.w["out"] + self.w["out0"]

    def gradient(self, chunks: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w, count = self.w, np.diff(np.concatenate((first, [len(chunks)])))
        pooled, best, win = self.pooled(chunks, keep=True)
        relu = np.maximum(pooled, 0)
        feats = np.maximum(relu @ w["features"] + w["features0"], 0)
        mean, top = np.add.reduceat(feats, first) / count[:, None], np.maximum.reduceat(feats, first)
        both = np.concatenate((mean, top), axis=1)
        p = 1 / (1 + np.exp(-np.clip(both @ w["out"] + w["out0"], -30, 30)))
        d = ((p - label) / len(label)).astype(np.float32)
        g = {"out": both.T @ d, "out0": d.sum(keepdims=True)}
        d_both = d[:, None] * w["out"]
        d_feats = np.repeat(d_both[:, :FEATURES] / count[:, None], count, axis=0)
        d_feats += np.repeat(d_both[:, FEATURES:], count, axis=0) * (feats == np.repeat(top, count, axis=0))
        d_feats *= feats > 0
        g["features"], g["features0"] = relu.T @ d_feats, d_feats.sum(0)
        d_pool = (d_feats @ w["features"].T) * (pooled > 0)
        hit = np.take_along_axis(win, best[:, :, None], 1)  # chunk, filter, window
        g["filters"], g["filters0"] = np.einsum("cf,cfk->kf", d_pool, hit), d_pool.sum(0)
        d_win = (d_pool[:, :, None] * w["filters"].T[None]).reshape(-1, DIM)
        at = (best[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(len(chunks), -1)
        byte = np.take_along_axis(chunks, at, 1).ravel()
        g["embed"] = np.stack([np.bincount(byte, weights=d_win[:, k], minlength=256) for k in range(DIM)], axis=1)
        return g

    def train(self, docs: list[np.ndarray], label: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.004, seed: int = 11) -> Network:
        r, m = np.random.default_rng(seed), {k: (np.zeros_like(v, dtype=np.float64), np.zeros_like(v, dtype=np.float64)) for k, v in self.w.items()}
        step, total = 0, epochs * -(-len(docs) // batch)
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(docs), batch):
                pick, step = order[i : i + batch], step + 1
                size = np.array([len(docs[k]) for k in pick])
                for name, g in self.gradient(np.concatenate([docs[k] for k in pick]), np.cumsum(size) - size, label[pick]).items():
                    a, b = m[name]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    move = rate * (1 - step / (total + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                    self.w[name] = (self.w[name] - move).astype(np.float32)
        return self

    def score(self, buf: np.ndarray, offsets: np.ndarray, shift: float, group: int = 512) -> np.ndarray:
        """Probabilities of the texts of a block; chunks go through in groups of bounded size."""
        starts = [chunk_starts(n) for n in np.diff(offsets)]
        count = np.array([len(s) for s in starts])
        begin = np.concatenate(starts) + np.repeat(offsets[:-1], count)
        end = np.repeat(offsets[1:], count)
        feats = [self.chunk_features(self.pooled(cut(buf, begin[i : i + group], end[i : i + group]))) for i in range(0, len(begin), group)]
        logit = self.logit(np.concatenate(feats), np.cumsum(count) - count).astype(np.float64) + shift
        return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 5)  # sums differ in their last bits with what else is in a batch


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, sample_chunks: int, key: str, text: str, label: str, fold: int, fold_of: int):
    """(share of label 1 among all training labels, chunks of each sampled id, their labels). An id that repeats
    gives the chunks of one of its rows (the smallest bytes), so ``2 * sample`` rows come to the driver at most."""
    held = F.crc32(F.col("id").cast("string").cast("binary")) % fold_of == fold
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label")).where(~held)
    share = known.agg(F.avg("label")).first()[0]
    order = F.xxhash64("id")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "id").limit(sample)
        picked = part if picked is None else picked.union(part)

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.text_bytes(batch.column(2))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                at = chunk_starts(b - a)
                at = at[np.unique(np.linspace(0, len(at) - 1, min(len(at), sample_chunks)).astype(int))] + a
                out.append(cut(buf, at, np.full(len(at), b)).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "chunks"])

    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")  # 2 * sample rows at most
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("label", T.IntegerType()), T.StructField("chunks", T.BinaryType())])
    cuts = texts.select("id", "label", "text").mapInArrow(cut_rows, schema)
    rows = sorted(cuts.groupBy("id", "label").agg(F.min("chunks").alias("chunks")).collect(), key=lambda r: r.id)
    return share, [np.frombuffer(bytes(r.chunks), dtype=np.uint8).reshape(-1, CHUNK) for r in rows], np.array([r.label for r in rows], dtype=np.float32)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                   sample: int = 1200, sample_chunks: int = 8, epochs: int = 10, fold: int = 2, fold_of: int = 4, threshold: float = 0.7,
                   keep: list[str] | None = None) -> DataFrame:
    """Of each row: key, ``held_out``, ``score`` (probability of label 1), ``predicted`` (score >= threshold).
    ``keep``: columns of ``docs`` to return in place of the key."""
    share, chunks, label_of = training_rows(docs, labels, sample, sample_chunks, key, text, label, fold, fold_of)
    fixed = None if 0 < label_of.sum() < len(label_of) else float(not len(label_of) or label_of[0])
    net, shift = Network(), 0.0
    if fixed is None:
        net.train(chunks, label_of, epochs)
        shift = float(np.log(share / (1 - share)) - np.log(label_of.mean() / (1 - label_of.mean())))
    shared = spark.sparkContext.broadcast((net.w, shift, fixed))  # weights of a fixed size

    columns = keep or [key]
    B.batch_rows(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shift, fixed = shared.value
        net = Network()
        net.w = weights
        for batch in batches:
            buf, offsets = B.text_bytes(batch.column(len(columns)))
            scores = [np.full(j - i, fixed) if fixed is not None else net.score(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shift)
                      for i, j in B.blocks(offsets)]
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())],
                                  names=[f"c{i}" for i in range(len(columns))] + ["score"])

    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)] + [T.StructField("score", T.DoubleType())])
    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("text")).mapInArrow(run, schema)
    out = out.toDF(*columns, "_score")
    held = F.crc32(F.col(key).cast("string").cast("binary")) % fold_of == fold
    return out.select(*columns, F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")) \
        if keep is None else out.select(*columns, (F.col("_score") >= threshold).alias("_good")).where("_good").drop("_good")
