"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of ASCII letters and digits and of all other characters outside ASCII, A-Z in lower
case. A benchmark item of ``w`` words is compared with every window of ``w`` words of every text,
and with the whole of a text that has fewer:

* Both have a 64-bit SimHash of their ``words``-word shingles (with their counts).
* An index of ``BLOCKS`` blocks of bits holds the items of each window size. Two fingerprints at
  most ``radius`` bits apart agree in some block up to ``radius // BLOCKS`` bits, and each item stands
  under all values that near its own, so the index finds every fingerprint within the radius.
* The exact weighted Jaccard similarity of the shingles (with their counts) verifies each candidate.
  A shingle of the item weighs ``1 / m`` where ``m`` different items of the whole benchmark have it;
  a shingle that only the window has weighs as much as the item's do on average. So the similarity
  hangs on the window, the item and those ``m`` alone, and repeating an item changes nothing.

A window whose shingles of the item can't weigh enough for the similarity is not looked up; the
bound is exact. Items of fewer words than a shingle have their whole sequence as the only one.

Items with the same words count once in ``m``, which Spark sums over the whole benchmark. The benchmark is then taken in
blocks of at most ``block_bytes`` of text (a longer single item is a block of its own); each block is
sent to all tasks with its shingles' ``m``, and the texts are scanned once for it. The texts are never shuffled.

Null or empty texts and items, and such without words, match nothing. Repeated documents are reported
each, and so are items of equal words; benchmark rows of equal id and text are one item. An empty table on either side gives no match; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytewords as B
from tessera.llm.shared import written

BLOCKS = 8
RADIUS = 23  # the most that two flips a block find all of
UNIT = 1 << 32  # weight of a shingle of one item

_PART = np.ones(256, dtype=bool)  # bytes that belong to no word
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PART[_a:_b] = False


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[buf]
    starts, ends, at = B.word_spans(low, offsets, _PART)
    return B.span_hashes(low, starts, ends), at


def signs(shingles: np.ndarray) -> np.ndarray:
    """Running sums of what each shingle adds to each of the 64 bits; one row more than shingles."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.zeros((len(shingles) + 1, 64), dtype=np.int64)
    np.cumsum(2 * bits - 1, axis=0, out=total[1:])
    return total


def fingerprints(total: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the ``size`` shingles from each start."""
    return np.packbits(total[starts + size] - total[starts] > 0, axis=1, bitorder="little").view("<u8").ravel()


def near_values(value: int, flips: int, bits: int = 64 // BLOCKS) -> set[int]:
    """All values at most ``flips`` bits from ``value``."""
    out = {value}
    for _ in range(flips):
        out |= {v ^ (1 << b) for v in out for b in range(bits)}
    return out


class HammingIndex:
    """Fingerprints by their group (a window size) and the values near each of their blocks."""

    def __init__(self, prints: np.ndarray, group: np.ndarray, groups: int, radius: int):
        self.prints, self.radius = prints, radius
        self.start, self.items = [], []
        near = np.array([sorted(near_values(v, radius // BLOCKS)) for v in range(256)], dtype=np.int64)
        for block in range(BLOCKS):
            keys = (group.astype(np.int64)[:, None] << 8 | near[self._value(prints, block)]).ravel()
            who = np.repeat(np.arange(len(prints), dtype=np.int32), near.shape[1])
            order = np.argsort(keys, kind="stable")
            self.items.append(who[order])
            self.start.append(np.searchsorted(keys[order], np.arange((groups << 8) + 1)))

    @staticmethod
    def _value(prints: np.ndarray, block: int) -> np.ndarray:
        return (prints >> np.uint64(8 * block)).astype(np.int64) & 255

    def search(self, prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of all of one group within the radius."""
        found = []
        for block in range(BLOCKS):
            key = group << 8 | self._value(prints, block)
            a, n = self.start[block][key], self.start[block][key + 1] - self.start[block][key]
            q = np.repeat(np.arange(len(prints)), n)
            i = self.items[block][np.arange(len(q)) + np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n)]
            found.append(np.stack((q, i))[:, np.bitwise_count(prints[q] ^ self.prints[i]) <= self.radius])
        q, i = np.unique(np.concatenate(found, axis=1), axis=1)
        return q, i, np.bitwise_count(prints[q] ^ self.prints[i]).astype(np.int64)


def item_shingles(texts: pa.Array, words: int) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """Of each item its shingles, its number of words, and a digest of its words."""
    buf, offsets = B.text_bytes(texts)
    hashes, at = word_hashes(buf, offsets)
    size = np.diff(at)
    sets = [B.shingles(hashes[at[r] : at[r + 1]], np.array([0, n]), min(words, n) or 1)[0] for r, n in enumerate(size.tolist())]
    return sets, size, [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest() for a, b in zip(at[:-1], at[1:])]


class Benchmark:
    """One block of the benchmark: its shingles, their weights, and an index for each window size.

    ``shared``: sorted shingles that several items of the whole benchmark have, and how many; without it the block is the whole.
    """

    def __init__(self, items: list[tuple[object, str]], words: int, radius: int, shared: tuple[np.ndarray, np.ndarray] | None = None, least: float = 0.0):
        self.words = words
        sets, size, texts = item_shingles(pa.array([t for _, t in items], pa.string()), words)
        self.ids = [i for i, _ in items]
        held = Counter(h for r in dict(zip(texts, range(len(texts)))).values() for h in set(sets[r].tolist()))
        self.known = np.array(sorted(held), dtype=np.uint64)
        many = np.array([held[h] for h in self.known.tolist()], dtype=np.int64)
        if shared is not None:
            many[:] = 1
            many[np.searchsorted(self.known, shared[0])] = shared[1]
        self.weights = np.maximum(1, UNIT // np.maximum(1, many))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.rows = np.flatnonzero(size)
        self.sets = {r: Counter(sets[r].tolist()) for r in self.rows.tolist()}
        self.sizes, group = np.unique(size[self.rows], return_inverse=True)
        # what the known shingles of a window must weigh to match an item, and any item of its size
        self.need = np.array([int(self.weight(sets[r])[0].sum()) for r in self.rows.tolist()], dtype=np.float64) * (least * (1 - 1e-9))
        self.least_need = np.full(len(self.sizes), np.inf)
        np.minimum.at(self.least_need, group, self.need)
        prints = [fingerprints(signs(sets[r]), np.array([0]), len(sets[r])) for r in self.rows.tolist()]
        self.index = HammingIndex(np.concatenate([np.zeros(0, np.uint64), *prints]), group, len(self.sizes), radius)

    def weight(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of shingles (0 if the block has not got them), and whether the block has them."""
        weight, known = np.zeros(len(shingles), dtype=np.int64), self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(known)
        if len(maybe):
            slot = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
            same = self.known[slot] == shingles[maybe]
            known[maybe] = same
            weight[maybe[same]] = self.weights[slot[same]]
        return weight, known

    def similarity(self, one: Counter, other: Counter) -> float:
        """Of a window's shingles and an item's: weights are the item's, and their mean for what only the window has."""
        weight = dict(zip(other, self.weight(np.array(list(other), dtype=np.uint64))[0].tolist()))
        both = sum(min(n, one[h]) * weight[h] for h, n in other.items())
        whole, size = sum(n * weight[h] for h, n in other.items()), other.total()
        more = sum(n - min(n, other[h]) for h, n in one.items())
        return both * size / (whole * (size + more))

    def matches(self, hashes: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int, int, int, float, int]]:
        """(row, item, first word, words, similarity, distance): of each row and item the best window."""
        best: dict[tuple[int, int], tuple] = {}
        for k in sorted({min(self.words, w) for w in self.sizes.tolist()}):
            shingles, to = B.shingles(hashes, at, k)
            weight, known = self.weight(shingles)
            hits = np.flatnonzero(known)
            for row in np.unique(np.searchsorted(to, hits, "right") - 1).tolist():
                if at[row + 1] - at[row] >= k:
                    self._row(row, shingles[to[row] : to[row + 1]], weight[to[row] : to[row + 1]], known[to[row] : to[row + 1]], k, least, best)
        return [(row, item, *x) for (row, item), x in sorted(best.items())]

    def _row(self, row: int, shingles: np.ndarray, weight: np.ndarray, known: np.ndarray, k: int, least: float, best: dict) -> None:
        seen = np.concatenate(([0], np.cumsum(weight)))
        for a, b in self._stretches(known, k):
            total = signs(shingles[a:b])
            places, prints, groups, held_by = [], [], [], []
            for g, w in enumerate(self.sizes.tolist()):
                size = w - k + 1
                if min(self.words, w) == k and (size <= b - a or a == 0 and len(shingles) < size):
                    size = min(size, len(shingles))  # a shorter text is one window
                    starts = np.arange(b - a - size + 1)
                    held = seen[a + starts + size] - seen[a + starts]
                    enough = (held > 0) & (held >= self.least_need[g])
                    starts = starts[enough]
                    held_by.append(held[enough])
                    places.append(a + starts)
                    prints.append(fingerprints(total, starts, size))
                    groups.append(np.full(len(starts), g))
            if not places:
                continue
            place, group, held = np.concatenate(places), np.concatenate(groups), np.concatenate(held_by)
            q, i, d = self.index.search(np.concatenate(prints), group)
            enough = held[q] >= self.need[i]
            q, i, d = q[enough], i[enough], d[enough]
            for n in np.lexsort((q, d)).tolist():
                first, item = int(place[q[n]]), int(self.rows[i[n]])
                w = min(int(self.sizes[group[q[n]]]), len(shingles) + k - 1)
                s = self.similarity(Counter(shingles[first : first + w - k + 1].tolist()), self.sets[item])
                key, value = (row, item), (first, w, s, int(d[n]))
                if s >= least and (key not in best or (-s, first) < (-best[key][2], best[key][0])):
                    best[key] = value

    def _stretches(self, known: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """Ranges of shingles within reach of a known one, of bounded length where no item is longer."""
        reach = max(w for w in self.sizes.tolist() if min(self.words, w) == k) - k
        hits = np.flatnonzero(known)
        cuts = np.flatnonzero(np.diff(hits) > 2 * reach + 1) + 1
        for part in np.split(hits, cuts):
            for s in range(int(part[0]) - reach, int(part[-1]) + 1, step := max(4096, reach)):
                # windows that begin in [s, s + step)
                yield max(0, s), min(len(known), s + step + reach)


def shared_shingles(some: DataFrame, words: int) -> DataFrame:
    """(shingle, n) of the shingles that n > 1 items with different words have; ``some``: (i, t)."""
    return _item_rows(some.select("t").distinct(), words).distinct().groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")


def _item_rows(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, digest in zip(*item_shingles(batch.column(0), words)[::2]):
                one = np.unique(sets).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(one), int.from_bytes(digest, "little", signed=True))), pa.array(one)], names=["words", "shingle"])

    return texts.mapInArrow(run, "words long, shingle long")


def benchmark_blocks(spark: SparkSession, benchmark: DataFrame, item: str, text: str, words: int, block_bytes: int) -> Iterator[tuple[list[tuple[object, str]], tuple[np.ndarray, np.ndarray]]]:
    """The benchmark in blocks of bounded size, one at a time at the driver, each with its shared shingles."""
    some = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null").distinct()  # a repeated row is one item
    size = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = 1 + 2 * size // block_bytes if size > block_bytes else 1
    shared = shared_shingles(some, words) if parts == 1 else written(spark, shared_shingles(some, words), "shingles")
    for p in range(parts):
        rows = some if parts == 1 else some.where(F.pmod(F.xxhash64("t", "i"), F.lit(parts)) == p)
        found = [(r.i, r.t) for r in rows.collect()]
        if found:
            own = shared if parts == 1 else shared.join(_item_rows(rows.select("t").distinct(), words).select("shingle").distinct(), "shingle", "left_semi")
            own = own.toArrow()
            h, n = own.column("shingle").to_numpy().view(np.uint64), own.column("n").to_numpy()
            order = np.argsort(h)
            yield sorted(found, key=lambda r: (str(r[0]), r[1])), (h[order], n[order])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = RADIUS, block_bytes: int = 16 << 20) -> DataFrame:
    """(key, item, ``first_word``, ``n_words``, ``similarity``, ``distance``) of each text and item: its best window."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("item", benchmark.schema[item].dataType), T.StructField("first_word", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.LongType())])
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, many = shared.value
            of = Benchmark(items, words, radius, many, similarity)
            for batch in batches:
                found = _found(of, batch.column(1), similarity)
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.record_batch([batch.column(0).take(rows), pa.array([of.ids[f[1]] for f in found]).cast(item_type), *[pa.array([f[2 + c] for f in found], t) for c, t in enumerate(types)]],
                                      names=schema.names)
        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item].dataType)
    B.batch_rows(spark)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for block in benchmark_blocks(spark, benchmark, item, item_text, words, block_bytes):
        out = out.union(texts.mapInArrow(scan(spark.sparkContext.broadcast(block)), schema))
    return out.withColumnsRenamed({"key": key, "item": item})


def _found(of: Benchmark, texts: pa.Array, least: float) -> list[tuple]:
    buf, offsets = B.text_bytes(texts)
    out = []
    for i, j in B.blocks(offsets):
        hashes, at = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out += [(i + m[0], *m[1:]) for m in of.matches(hashes, at, least)] if len(of.rows) else []
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", words: int = 5,
                   similarity: float = 0.8, radius: int = RADIUS, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item."""
    place = docs.columns.index(text)
    B.batch_rows(spark)

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, many = shared.value
            of = Benchmark(items, words, radius, many, similarity)
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                keep[[f[0] for f in _found(of, batch.column(place), similarity)]] = False
                yield batch.filter(pa.array(keep))
        return run

    for block in benchmark_blocks(spark, benchmark, item, item_text, words, block_bytes):
        docs = docs.mapInArrow(clean(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
