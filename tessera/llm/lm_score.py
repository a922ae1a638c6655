"""Language-model scores: a causal self-attention model on subword ids, and a smoothed word base.

The model reads pieces of a merge-type vocabulary (A-Z in lower case, white space as single spaces).
One attention layer over a window of ``WINDOW`` inputs predicts the class of the next piece in two steps (one of ``GROUPS`` groups,
then one of its members); the piece within its class follows the counts of the whole training corpus. The most frequent pieces are
classes of their own. Windows overlap: each after the first begins ``OVERLAP`` inputs early for context, and every piece, the end
included, is scored once. All windows of a block go through batched matrix products under one causal mask.

Training rows are those whose ``crc32(id as text) mod fold_of`` is not ``fold``; counts of words and
pieces cover all of them, and so do the network's weights: in each of ``epochs`` passes every task takes gradient steps on all
of its rows from common weights. For training, windows stand side by side, so each piece is an input of one of them, and
every input predicts what follows it: each piece and each end is a target once. Spark adds up how far each
task moved the weights, by the inputs it read (of a piece's embedding: by how often it read the piece), in two levels of groups. The sums are whole
numbers of fixed size, so the order of tasks changes nothing; the way the rows are dealt to tasks does. On demand only the
``sample`` ids of smallest hash are fitted on.

Texts are taken in blocks of at most ``block_bytes``, of training rows or of others. Each block is encoded once and written to the
shared folder with its pieces, which counting, training and scoring read from there.

Base: the sum over the words of a text and its end of ``log10((c + 1) / (N + V + 1))``. Each block keeps a table of its distinct words. Those tables,
not the words of every text, are summed over the corpus and joined back, and only counts that the block cannot know
itself return to it.

Null or empty text: only the end. Very long texts are read in windows like all others, in a block of their own. Null ids belong to the training rows. Repeated rows are rows of their own; an empty
table gives an empty result, a table without training rows has N = V = 0; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytewords as B
from tessera.llm import sentencepiece_bpe as SP
from tessera.llm.shared import written

WINDOW, OVERLAP, DIM, QUERIES = 16, 4, 8, 4
SINGLE, BINS, GROUPS = 40, 24, 8  # classes make a square of groups and members
PAD = 0

_NORMAL = B.LOWER.copy()
_NORMAL[B.SPACE] = 0x20


def windows(size: np.ndarray, stride: int = WINDOW - OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first input, first scored input) of the windows of sequences with ``size`` inputs each."""
    n = 1 + np.maximum(0, -(-(size - WINDOW) // stride))
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, k * stride, np.where(k > 0, k * stride + WINDOW - stride, 0)


def _in_range(sums: np.ndarray) -> bool:
    """Whether sums of exponentials neither overflowed nor vanished."""
    return not sums.size or bool(sums.min() > 1e-15 and sums.max() < 1e15)  # NaN is neither


def _keep_freed() -> None:
    """Let the allocator keep what a step frees for the next one: it returns less after one such array was freed."""
    np.empty(16 << 20, np.uint8)


class Attention:
    """Weights, forward pass, and training by gradients of the class cross-entropy."""

    def __init__(self, vocabulary: int, groups: int = GROUPS, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.groups = groups
        self.w = {"embed": f(vocabulary, DIM), "place": f(WINDOW, DIM), "query": f(DIM, DIM), "pair": f(DIM, 2 * DIM), "out": f(2 * DIM, groups + groups * groups),
                  "bias": np.zeros(groups + groups * groups, np.float32)}

    def _mixed(self, x: np.ndarray, xq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries from ``xq`` at the places ``at`` (a row for each window, or one for all) over the inputs ``x``."""
        w = self.w
        q = (xq.reshape(-1, DIM) @ (w["query"] * np.asarray(DIM**-0.5, w["query"].dtype))).reshape(xq.shape)
        pair = (x.reshape(-1, DIM) @ w["pair"]).reshape(*x.shape[:2], 2 * DIM)
        k, v = pair[..., :DIM], pair[..., DIM:]
        seen = np.arange(WINDOW) <= at[..., None]
        ones = np.ones((WINDOW, DIM), v.dtype)  # sums of the weights, one for each column of what they mix: divided without broadcasting
        a = q @ k.transpose(0, 2, 1)
        with np.errstate(all="ignore"):
            np.exp(a, out=a)
            a *= seen.astype(a.dtype)
            mixed = a @ v
            sums = (a.reshape(-1, WINDOW) @ ones).reshape(mixed.shape)
        if not _in_range(sums):  # again, by each row's maximum, the windows whose exponentials leave the range of 32-bit numbers
            left = np.flatnonzero(~((sums[..., 0] > 1e-15) & (sums[..., 0] < 1e15)).all(axis=1))
            again = np.where(seen if seen.ndim == 2 else seen[left], q[left] @ k[left].transpose(0, 2, 1), -np.inf)
            again -= again.max(axis=2, keepdims=True)
            a[left] = np.exp(again)
            mixed[left], sums[left] = a[left] @ v[left], a[left] @ ones
        mixed /= sums
        return q, k, v, a, sums, mixed

    def _by_group(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of the targets by their group, and (group, first, end) of the groups that occur."""
        group = target // self.groups
        if self.groups < 256:
            group = group.astype(np.uint8)  # sorted by radix
        ends = np.cumsum(np.bincount(group, minlength=self.groups)).tolist()
        return np.argsort(group, kind="stable"), [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]

    @staticmethod
    def _joined(x: np.ndarray, mixed: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Of some inputs: themselves, what they have mixed in, and 1 for the bias."""
        h = np.empty((len(some), 2 * DIM + 1), x.dtype)
        h[:, :DIM], h[:, DIM : 2 * DIM], h[:, 2 * DIM] = x.reshape(-1, DIM).take(some, axis=0), mixed.reshape(-1, DIM).take(some, axis=0), 1
        return h

    def _members(self, group: int) -> slice:
        """The columns of the members of a group."""
        return slice(self.groups * (group + 1), self.groups * (group + 2))

    def _parts(self, h: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        """Logits of the groups and of the members of the target's group, their exponentials, and the sums of those.

        Rows stand by group, so each group's members are one product with the rows that need them."""
        out, every = np.concatenate((self.w["out"], self.w["bias"][None])), np.ones(self.groups, h.dtype)
        one, two = h @ out[:, : self.groups], np.empty((len(h), self.groups), h.dtype)
        for group, a, b in parts:
            np.matmul(h[a:b], out[:, self._members(group)], out=two[a:b])
        for shifted in (False, True):
            if shifted:
                one, two = one - one.max(axis=1, keepdims=True), two - two.max(axis=1, keepdims=True)
            with np.errstate(all="ignore"):
                up, down = np.exp(one), np.exp(two)
                s, t = up @ every, down @ every
            if _in_range(s) and _in_range(t):
                break
        return one, two, up, down, s, t

    def log_probability(self, ids: np.ndarray, target: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the target classes at the counted inputs, in a row."""
        x = self.w["embed"].take(ids, axis=0)
        x += self.w["place"]
        mixed = self._mixed(x, x, np.arange(WINDOW))[-1]
        some = np.flatnonzero(counted)
        target = target.ravel()[some]
        order, parts = self._by_group(target)
        some, target, n = some[order], target[order], np.arange(len(some))
        one, two, _, _, s, t = self._parts(self._joined(x, mixed, some), parts)
        out = np.empty(len(some), x.dtype)
        n *= self.groups
        out[order] = one.reshape(-1).take(n + target // self.groups) + two.reshape(-1).take(n + target % self.groups) - np.log(s * t)
        return out

    def gradient(self, ids: np.ndarray, at: np.ndarray | None, target: np.ndarray, weight: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss (on demand) of the targets at the places ``at`` of each window (none given: at all of its places), its gradients
        (of the embedding: by input), and the inputs."""
        w, G = self.w, self.groups
        x = w["embed"].take(ids, axis=0)
        x += w["place"]
        each = np.arange(len(ids))[:, None]
        xq = x if at is None else x[each, at]
        q, k, v, a, sums, mixed = self._mixed(x, xq, np.arange(WINDOW) if at is None else at)
        target, weight, rows = target.ravel(), weight.ravel(), target.size
        some = np.flatnonzero(weight)  # what weighs nothing adds nothing
        order, parts = self._by_group(target[some])
        some = some[order]
        target, weight, n = target[some], weight[some], np.arange(len(some))
        h = self._joined(xq, mixed, some)
        _, _, one, two, s, t = self._parts(h, parts)
        total = max(1.0, float(weight.sum()))
        group, member, share = target // G, target % G, (weight / total).astype(x.dtype)
        loss = float(-(np.log(one[n, group] / s * (two[n, member] / t)) * weight).sum() / total) if with_loss else 0.0
        one *= (share / s)[:, None]
        two *= (share / t)[:, None]
        for k1, first, end in parts:
            one[first:end, k1] -= share[first:end]
        two.reshape(-1)[n * G + member] -= share
        both = np.zeros((2 * DIM + 1, G + G * G), x.dtype)
        both[:, :G] = h.T @ one
        dh = np.zeros((len(some) + 1, 2 * DIM), x.dtype)  # the last row: of what weighs nothing
        np.matmul(one, w["out"][:, :G].T, out=dh[:-1])
        for group, first, end in parts:
            columns = self._members(group)
            dh[first:end] += two[first:end] @ w["out"][:, columns].T
            both[:, columns] = h[first:end].T @ two[first:end]
        g = {"out": both[:-1], "bias": both[-1]}
        where = np.full(rows, len(some))
        where[some] = n
        where *= 2  # halves of rows
        halves = dh.reshape(-1, DIM)
        dxq, dm = halves.take(where, axis=0).reshape(xq.shape), halves.take(where + 1, axis=0).reshape(xq.shape)
        dm /= sums  # the weights' own division
        da = dm @ v.transpose(0, 2, 1)
        da -= np.einsum("nid,nid->ni", dm, mixed)[..., None]
        da *= a
        dq = da @ k
        dq *= np.asarray(DIM**-0.5, x.dtype)
        dpair = np.empty((*x.shape[:2], 2 * DIM), x.dtype)
        np.matmul(da.transpose(0, 2, 1), q, out=dpair[..., :DIM])
        np.matmul(a.transpose(0, 2, 1), dm, out=dpair[..., DIM:])
        g["query"] = xq.reshape(-1, DIM).T @ dq.reshape(-1, DIM)
        g["pair"] = x.reshape(-1, DIM).T @ dpair.reshape(-1, 2 * DIM)
        dxq += (dq.reshape(-1, DIM) @ w["query"].T).reshape(xq.shape)
        dx = (dpair.reshape(-1, 2 * DIM) @ w["pair"].T).reshape(x.shape)
        if at is None:
            dx += dxq
        else:
            dx[each, at] += dxq  # places repeat only with weight 0, before the one that counts
        g["place"] = dx.sum(0)
        return loss, g, dx.reshape(-1, DIM)

    def train(self, blocks: Iterator[tuple[np.ndarray, ...]], rate: float, batch: int = 512, seed: int = 5) -> tuple[np.ndarray, int]:
        """Steps over all windows of the blocks; how often each piece was an input, and the number of inputs."""
        r, m = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items() if k != "embed"}
        _keep_freed()
        narrow = np.uint16 if len(self.w["embed"]) <= 1 << 16 else np.int32  # 16 bits are sorted by radix
        step, read, squares = 0, np.zeros(len(self.w["embed"]), dtype=np.int64), np.zeros(len(self.w["embed"]), np.float32)
        for ids, at, target, weight in blocks:
            order = r.permutation(len(ids))
            for i in range(0, len(ids), batch):
                pick, step = order[i : i + batch], step + 1
                now = ids.take(pick, axis=0)
                _, grads, dx = self.gradient(now, None if at is None else at[pick], target.take(pick, axis=0), weight.take(pick, axis=0), False)
                for name, g in grads.items():
                    one, two = m[name]
                    one += np.float32(0.1) * (g - one)
                    two += np.float32(0.01) * (g * g - two)
                    self.w[name] = self.w[name] - np.float32(rate / (1 - 0.9**step)) * one / (np.sqrt(two * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))
                flat = now.ravel()  # the embeddings that were read, each by its own sum of squares
                by = np.argsort(flat.astype(narrow), kind="stable")
                flat = flat.take(by)
                first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
                some, g = flat[first], np.add.reduceat(dx.take(by, axis=0), first, axis=0)
                squares[some] += np.einsum("nd,nd->n", g, g) / np.float32(DIM)
                self.w["embed"][some] -= np.float32(4 * rate) * g / (np.sqrt(squares[some]) + np.float32(1e-8))[:, None]
            inputs = weight > 0 if at is None else np.arange(WINDOW) <= at[:, -1:]
            read += np.bincount(ids[inputs], minlength=len(read))
        return read, int(read.sum())


class Classes:
    """Each piece's class, and its probability within the class by smoothed corpus counts."""

    def __init__(self, counts: np.ndarray):
        smooth = counts + 1.0
        order = np.argsort(-smooth, kind="stable")
        self.of = np.empty(len(counts), dtype=np.int16)
        self.of[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
        rest = smooth[order[SINGLE:]]
        share = (np.cumsum(rest) - rest) / max(1.0, rest.sum())
        self.of[order[SINGLE:]] = SINGLE + np.minimum((share * BINS).astype(np.int64), BINS - 1)
        self.inside = np.log(smooth) - np.log(np.bincount(self.of, weights=smooth, minlength=SINGLE + BINS))[self.of]


def layout(ids: np.ndarray, at: np.ndarray, begin: int, end: int, stride: int = WINDOW - OVERLAP) -> tuple[np.ndarray, ...]:
    """Windows of all sequences: inputs, targets, which targets count, and the row of each window."""
    rows, size = len(at) - 1, np.diff(at) + 1
    full = np.empty(len(ids) + 2 * rows, dtype=np.int64)  # begin, pieces, end of each row
    first = at[:-1] + 2 * np.arange(rows)
    inner = np.ones(len(full), dtype=bool)
    inner[first] = inner[first + size] = False
    full[first], full[first + size], full[inner] = begin, end, ids
    row, start, scored = windows(size, stride)
    place = start[:, None] + np.arange(WINDOW)
    there = place < size[row][:, None]
    where = np.where(there, first[row][:, None] + place, 0)
    full = full.astype(np.int32)
    return np.where(there, full[where], np.int32(PAD)), np.where(there, full[where + there], np.int32(PAD)), there & (place >= scored[:, None]), row


def last_places(counted: np.ndarray, queries: int = QUERIES) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the places of its last ``queries`` inputs, and 1 for each that there is."""
    at = counted.sum(axis=1)[:, None] - queries + np.arange(queries)
    return np.maximum(at, 0), (at >= 0).astype(np.float32)


class Scorer:
    """Log10 probabilities of the texts of a block."""

    def __init__(self, model: bytes, weights: dict[str, np.ndarray], counts: np.ndarray):
        self.encoder = SP._encoder(model, False)
        self.classes = Classes(counts)
        self.net = Attention(1)
        self.net.w = weights

    def score(self, buf: np.ndarray, offsets: np.ndarray, group: int = 512) -> np.ndarray:
        ids, at, _ = self.encoder.encode(_NORMAL[buf], offsets)
        return self.score_ids(ids, at, group)

    def score_ids(self, ids: np.ndarray, at: np.ndarray, group: int = 512) -> np.ndarray:
        """The same of texts whose pieces are at hand (``at``: where each text's begin, one more at the end)."""
        p = self.encoder.pieces
        out = np.zeros(len(at) - 1)
        inputs, targets, counted, row = layout(ids.astype(np.int64), at, p.bos, p.eos)
        classes, inside, n = self.classes.of.take(targets), self.classes.inside.take(targets[counted]), counted.sum(axis=1)
        ends = np.cumsum(n)
        for i in range(0, len(row), group):
            j = min(i + group, len(row))
            log = self.net.log_probability(inputs[i:j], classes[i:j], counted[i:j]).astype(np.float64) + inside[ends[i] - n[i] : ends[j - 1]]
            out += np.bincount(np.repeat(row[i:j], n[i:j]), weights=log, minlength=len(out))
        return out / math.log(10)


def in_fold(key: str, fold: int, fold_of: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % fold_of == fold, F.lit(False))


def piece_runs(batch: pa.RecordBatch, encoder: SP.Encoder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, where each text's begin and one more) of the runs of texts of a batch, or of the blocks that hold them encoded."""
    if "ids" in batch.schema.names:
        for ids, sizes, ends in zip(*(batch.column(c).to_pylist() for c in ("ids", "n_ids", "runs"))):
            at, ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i8")))), np.frombuffer(ends, "<i8").tolist()
            ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), _ids_kind(encoder.pieces.n))
            for i, j in zip([0, *ends], ends):
                yield ids[at[i] : at[j]].astype(np.int64), at[i : j + 1] - at[i]
    else:
        buf, offsets = B.text_bytes(batch.column("text"))
        for i, j in B.blocks(offsets):
            ids, at, _ = encoder.encode(_NORMAL[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
            yield ids.astype(np.int64), at


def word_hashes(buf: np.ndarray, body: np.ndarray, ends: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and at which word each text begins (one more at the end), from the segments: each has one word at its end, or none."""
    has = ends > body
    has[has] = buf[ends[has] - 1] != 0x20
    words = keys[has]
    spaced = np.flatnonzero(buf[body[has]] == 0x20)  # these have more spaces than one, which their hashes hold
    if len(spaced):
        space, end = np.flatnonzero(buf == 0x20), ends[has][spaced]
        words[spaced] = B.span_hashes(buf, space[np.searchsorted(space, end) - 1] + 1, end)
    return words, np.concatenate(([0], np.cumsum(has)))[at]


def _ids_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def runs_of_blocks(offsets: np.ndarray, limit: int) -> Iterator[list[tuple[int, int]]]:
    """Blocks of whole runs of rows, of at most ``limit`` bytes each, or of one longer run."""
    block: list[tuple[int, int]] = []
    for i, j in B.blocks(offsets, min(limit, B.BLOCK)):
        if block and offsets[j] - offsets[block[0][0]] > limit:
            yield block
            block = []
        block.append((i, j))
    if block:
        yield block


def piece_counts(texts: DataFrame, shared, vocabulary: int) -> np.ndarray:
    """How often each piece, and the end, occurs in all texts (or their blocks); the result is as long as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        encoder = SP._encoder(shared.value, False)
        for batch in batches:
            for ids, at in piece_runs(batch, encoder):
                total += np.bincount(ids, minlength=vocabulary)
                total[encoder.pieces.eos] += len(at) - 1
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["id", "n"])

    rows = texts.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary)
    for r in rows:
        counts[r.id] = r.n
    return counts


FIXED, PIECES = 1 << 24, 1024  # steps of a unit of weight in sums; pieces whose embeddings are added in a row
SHARES = 1024  # groups of tasks whose sums are added first


def fitted(texts: DataFrame, shared, counts: np.ndarray, epochs: int, sample: int | None = None, rate: float = 0.01) -> Attention:
    """The network, trained on all rows of ``texts`` (key, text; or blocks that hold them encoded), or on a sample of them (by key)."""
    spark, classes = texts.sparkSession, Classes(counts)
    net = Attention(len(classes.of))
    if sample is not None:
        chosen = texts.select("key").where("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
        texts = texts.join(F.broadcast(chosen), "key", "left_semi")
    small = [name for name in sorted(net.w) if name != "embed"]

    def run(now, rate: float):
        def windows_of(batches: Iterator[pa.RecordBatch], of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            encoder = SP._encoder(shared.value, False)
            for batch in batches:
                for ids, at in piece_runs(batch, encoder):
                    x, y, c, _ = layout(ids, at, encoder.pieces.bos, encoder.pieces.eos, WINDOW)
                    yield x, None, of[y], c.astype(np.float32)  # at all places

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, of = now.value
            own = Attention(1)
            own.w = {k: v.copy() for k, v in start.items()}
            read, total = own.train(windows_of(batches, of), rate)
            if not total:
                return
            moved = np.rint((own.w["embed"].astype(np.float64) - start["embed"]) * FIXED).astype(np.int64) * read[:, None]
            some = [k for k in range(0, len(read), PIECES) if read[k : k + PIECES].any()]
            rows = [(k, np.concatenate((read[k : k + PIECES], moved[k : k + PIECES].ravel()))) for k in some]
            rows.append((-1, np.concatenate(([total], *[np.rint((own.w[n].astype(np.float64) - start[n]) * FIXED).astype(np.int64).ravel() * total for n in small]))))
            share = pa.array(np.full(len(rows), TaskContext.get().partitionId() % SHARES))
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), share, pa.array([_packed(v, "<i8") for _, v in rows], pa.binary())], names=["part", "share", "sums"])
        return task

    def add(rows: pa.Table) -> pa.Table:
        total = sum(_unpacked(x, "<i8") for x in rows.column("sums").to_pylist())
        return pa.table([rows.column("part").slice(0, 1), rows.column("share").slice(0, 1), pa.array([_packed(total, "<i8")], pa.binary())], names=["part", "share", "sums"])

    schema = "part long, share long, sums binary"
    for p in range(epochs):
        now = spark.sparkContext.broadcast((net.w, classes.of))  # as long as the vocabulary
        sums = texts.drop("key").mapInArrow(run(now, rate * (epochs - p) / epochs), schema)
        sums = sums.groupBy("part", "share").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema).collect()
        w = {k: v.astype(np.float64) for k, v in net.w.items()}
        for r in sums:
            v = _unpacked(bytes(r.sums), "<i8")
            if r.part >= 0:
                n = len(v) // (DIM + 1)
                w["embed"][r.part : r.part + n] += v[n:].reshape(n, DIM) / (FIXED * np.maximum(1.0, v[:n]))[:, None]
            else:
                at = 1
                for name in small:
                    w[name] += v[at : at + w[name].size].reshape(w[name].shape) / (FIXED * float(v[0]))
                    at += w[name].size
        net.w = {k: v.astype(np.float32) for k, v in w.items()}
    return net


def _packed(a: np.ndarray, kind: str) -> bytes:
    """Bytes of like weight side by side, compressed."""
    raw = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def lm_scores(spark: SparkSession, docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", fold: int = 2, fold_of: int = 7,
              sample: int | None = None, epochs: int = 1, block_bytes: int = 8 << 20) -> DataFrame:
    """Of each row: key, ``held_out``, ``n_tokens`` (words and the end), ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    shared = spark.sparkContext.broadcast(model)  # one vocabulary file
    B.batch_rows(spark, 4000)  # a block of words is at most one batch
    vocabulary = len(SP._encoder(model, False).pieces.kinds)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), in_fold(key, fold, fold_of).alias("held"))

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = SP._encoder(shared.value, False), 0
        _keep_freed()
        for batch in batches:
            buf, offsets = B.text_bytes(batch.column(1))
            held = bool(len(batch)) and batch.column(2)[0].as_py()  # one of the two parts of the table
            for runs in runs_of_blocks(offsets, block_bytes):
                i, j = runs[0][0], runs[-1][1]
                words, first, ids, sizes = [], [np.zeros(1, np.int64)], [], []
                for a, b in runs:
                    part, at = _NORMAL[buf[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                    plain, plain_at = SP.without_marks(part, at)
                    found = SP.spans(plain, plain_at)
                    pieces, of_text, _ = encoder.encode_spans(plain, *found)
                    ids.append(pieces.astype(_ids_kind(encoder.pieces.n)))
                    sizes.append(np.diff(of_text))
                    hashes, of_row = word_hashes(part, *(found if plain is part else SP.spans(part, at)))
                    words.append(hashes)
                    first.append(of_row[1:] + first[-1][-1])
                words, first = np.concatenate(words), np.concatenate(first)
                table = pa.array(words).dictionary_encode()
                known, local = table.dictionary.to_numpy(), table.indices.to_numpy()
                size = np.bincount(local, minlength=len(known))
                order, place = np.argsort(-size, kind="stable"), np.empty(len(size), np.int64)
                place[order] = np.arange(len(size))  # frequent words have small numbers
                train = np.zeros_like(size) if held else size[order]
                block = TaskContext.get().partitionId() << 32 | n
                n += 1
                one = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)), pa.array([held]),
                       *[pa.array([x], pa.binary()) for x in (np.diff(first).astype("<i8").tobytes(), _packed(place[local], "<u4"), known[order].astype("<u8").tobytes(), _packed(train, "<u4"),
                                                             zstandard.ZstdCompressor(level=3).compress(np.concatenate(ids).tobytes()), np.concatenate(sizes).astype("<i8").tobytes(),
                                                             (np.array([b for _, b in runs]) - i).astype("<i8").tobytes())]]
                yield pa.record_batch(one, names=names)

    names = ["block", "keys", "held", "n_words", "words", "known", "train", "ids", "n_ids", "runs"]
    key_type = docs.schema[key].dataType
    head = [T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("held", T.BooleanType())]
    binary = lambda *of: [T.StructField(c, T.BinaryType()) for c in of]
    parts = texts.where("not held").mapInArrow(block_rows, T.StructType(head + binary(*names[3:]))).union(texts.where("held").mapInArrow(block_rows, T.StructType(head + binary(*names[3:]))))
    blocks = written(spark, parts, "blocks")  # the texts are encoded here and nowhere else
    encoded = blocks.where("not held").select("ids", "n_ids", "runs")
    counts = piece_counts(encoded, shared, vocabulary)
    net = fitted(encoded if sample is None else texts.where("not held").select("key", "text"), shared, counts, epochs, sample)
    weights = spark.sparkContext.broadcast((net.w, counts))  # as long as the vocabulary

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, known, train in zip(*(batch.column(c).to_pylist() for c in range(3))):
                h, n = np.frombuffer(known, "<u8").view(np.int64), _unpacked(train, "<u4").astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(h), block)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h), pa.array(n)], names=["block", "i", "h", "n"])

    words = blocks.select("block", "known", "train").mapInArrow(word_rows, "block long, i int, h long, n long")
    corpus = written(spark, words.where("n > 0").groupBy("h").agg(F.sum("n").alias("c")), "words")
    of_words = corpus.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    trained = int(counts[SP._encoder(model, False).pieces.eos])  # texts, each with an end
    tokens, types = of_words[0] + trained, of_words[1] + (trained > 0)
    news = words.join(corpus, "h").where("c <> n").select("block", "i", "c")

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, *weights.value)
        _keep_freed()
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                score = [scorer.score_ids(ids, at) for ids, at in piece_runs(one, scorer.encoder)]
                yield pa.record_batch([*one.columns[:6], pa.array([np.concatenate(score).astype("<f8").tobytes()], pa.binary())], names=scored)

    scored = ["block", "keys", "held", "n_words", "words", "train", "score"]
    left = blocks.select(*scored[:6], "ids", "n_ids", "runs").mapInArrow(score_rows, T.StructType(head + binary(*scored[3:])))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            c = _unpacked(r["train"], "<u4").astype(np.int64)
            c[right.column("i").to_numpy()] = right.column("c").to_numpy()
            local, size = _unpacked(r["words"], "<u4").astype(np.int64), np.frombuffer(r["n_words"], "<i8")
            row = np.repeat(np.arange(len(size)), size)
            log = np.log10((c + 1) / (tokens + types + 1))
            base = np.bincount(row, weights=log[local], minlength=len(size)) + math.log10((trained + 1) / (tokens + types + 1))
            seen = np.bincount(row, weights=(c > 0)[local], minlength=len(size)).astype(np.int64) + (trained > 0)
            out.append(pa.table([pa.array(r["keys"], left.schema.field("keys").type.value_type), pa.array(np.full(len(size), r["held"])), pa.array(size + 1), pa.array(seen),
                                 pa.array(np.full(len(size), tokens)), pa.array(base), pa.array(np.frombuffer(r["score"], "<f8"))], names=result.names))
        return pa.concat_tables(out) if out else pa.schema([(f, t) for f, t in empty]).empty_table()

    result = T.StructType([T.StructField("key", key_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_type

    empty = [(f.name, to_arrow_type(f.dataType)) for f in result.fields]
    return left.groupBy("block").cogroup(news.groupBy("block")).applyInArrow(finish, result).withColumnRenamed("key", key)
