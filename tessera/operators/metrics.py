"""Distillation metrics over tables of vectors.

Rows are ``(pos, layer, teacher ARRAY<DOUBLE>, student ARRAY<DOUBLE>)``.
Per-row maths are higher-order array expressions in the JVM; batch means are
partial aggregates.  Logits may also come in long form, one row a position and vocabulary entry:
their softmax states add up across tasks.  D7 (hidden -> logits -> KL) streams tiles of
the two projection matrices past tiles of positions, so neither side needs to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def logsumexp(x: Column) -> Column:
    """D1 core: one-pass (online) max-shifted log-sum-exp.

    The running max rescales the running sum, as in a blockwise softmax;
    nothing outside the lambda is referenced per element, so the cost is
    O(H) per row (an outer ``array_max`` inside the lambda would be O(H^2)).
    """
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("z"))

    def step(acc, e):
        m = F.greatest(acc["m"], e)
        return F.struct(m.alias("m"), (acc["z"] * F.exp(acc["m"] - m) + F.exp(e - m)).alias("z"))

    return F.aggregate(x, init, step, lambda acc: acc["m"] + F.log(acc["z"]))


def log_softmax(x: Column) -> Column:
    """Stable log-softmax of an array (``lse`` bound once via a
    single-element ``transform`` so it is evaluated once per row)."""
    return F.element_at(F.transform(F.array(logsumexp(x)), lambda lse: F.transform(x, lambda e: e - lse)), 1)


def kl_row(t: Column, s: Column) -> Column:
    """D2 per row: sum p_t (log p_t - log p_s)."""
    def body(lt_lse, ls_lse):
        return _sum(F.zip_with(t, s, lambda a, b: F.exp(a - lt_lse) * ((a - lt_lse) - (b - ls_lse))))

    lses = F.array(F.struct(logsumexp(t).alias("lt"), logsumexp(s).alias("ls")))
    return F.element_at(F.transform(lses, lambda p: body(p["lt"], p["ls"])), 1)


def kl_grad(t: Column, s: Column, n: Column | int = 1) -> Column:
    """D3: d KL / d student logits = (p_s - p_t) / N."""
    n_c = n if isinstance(n, Column) else F.lit(n)
    return F.zip_with(log_softmax(s), log_softmax(t), lambda a, b: (F.exp(a) - F.exp(b)) / n_c)


def cross_entropy_row(logits: Column, target: Column) -> Column:
    """D4 per position: -log p(target) (target is 0-based); one pass for the normaliser, one element read."""
    return logsumexp(logits) - F.element_at(logits, (target + 1).cast("int"))


def next_targets(df: DataFrame, pos: str = "pos", token: str = "token", out: str = "target") -> DataFrame:
    """Each position's target is the token at the next one; the last position has none and goes."""
    after = df.select((F.col(pos) - 1).alias(pos), F.col(token).alias(out))
    return df.join(after, pos)


def alignment_row(t: Column, s: Column) -> Column:
    """D5 per position: ||t - s||_2 / sqrt(H)."""
    d2 = _sum(F.zip_with(t, s, lambda a, b: (a - b) * (a - b)))
    return F.sqrt(d2) / F.sqrt(F.size(t).cast("double"))


def batch_kl(pairs: DataFrame) -> DataFrame:
    """D2 batch mean: sum of row KL / N."""
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(kl_row(F.col("teacher"), F.col("student"))).alias("kl"))


def cross_entropy(df: DataFrame, logits: str = "student", target: str = "target", by: list | None = None) -> DataFrame:
    """Mean CE and perplexity = exp(mean CE), optionally per group."""
    ce = cross_entropy_row(F.col(logits), F.col(target))
    g = df.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(ce).alias("ce_loss")).withColumn("perplexity", F.exp("ce_loss"))


def layer_mean(per_layer: DataFrame, loss_col: str, factor: float = 1.0) -> DataFrame:
    """Mean over layers of a per-layer loss times ``factor``; 0 when no layers."""
    return per_layer.agg(F.count(F.lit(1)).alias("n_layers"),
                         (F.coalesce(F.avg(loss_col), F.lit(0.0)) * factor).alias("layer_mean"))


# ---- D1, D2 in long form --------------------------------------------------------

BIN = 64.0


def _rescaled(states: str, value: str, shift: str, top: str) -> Column:
    """Sum of a state's values, each brought to the top shift."""
    return _sum(F.transform(states, lambda p: p[value] * F.exp(p[shift] - F.col(top))))


def _states(values: DataFrame, keys: list[str], x: str, extra: str | None = None) -> DataFrame:
    """(keys, shift, z[, a]): of each key ``sum(exp(x - shift))`` and ``sum(exp(x - shift) * extra)``.

    A softmax state is a shift and a sum of exponentials under it, and states add up once they have the same shift. Here
    the shift is a multiple of ``BIN`` below the value, so it needs no maximum first: equal shifts are grouped, which Spark
    aggregates partially in each task, and a key has one state for each ``BIN`` that its values span. A
    value of minus infinity weighs nothing; nulls are left out; NaN makes its key's result NaN.
    """
    shift = F.when(F.col(x) == float("-inf"), F.lit(0.0)).when(F.isnan(x), F.lit(0.0)).otherwise(F.floor(F.col(x) / BIN).cast("double") * BIN)
    d = values.where(F.col(x).isNotNull()).withColumn("_shift", shift).withColumn("_w", F.exp(F.col(x) - F.col("_shift")))
    sums = [F.sum("_w").alias("_z")] + ([F.sum(F.when(F.col("_w") == 0, 0.0).otherwise(F.col("_w") * F.col(extra))).alias("_a")] if extra else [])
    states = d.groupBy(*keys, "_shift").agg(*sums)
    top = states.groupBy(*keys).agg(F.max(F.when(F.col("_z") > 0, F.col("_shift"))).alias("_m"), F.collect_list(F.struct("_shift", *(["_z", "_a"] if extra else ["_z"]))).alias("_p"))
    scaled = [_rescaled("_p", c, "_shift", "_m").alias(c) for c in (["_z", "_a"] if extra else ["_z"])]
    return top.withColumn("_m", F.coalesce(F.col("_m"), F.lit(0.0))).select(*keys, "_m", *scaled)


def logsumexp_long(logits: DataFrame, keys: list[str] = ["pos"], logit: str = "logit") -> DataFrame:  # noqa: B006
    """D1 core for a long table (keys, vocab_id, logit), whose positions may be spread over any number of tasks."""
    return _states(logits, keys, logit).select(*keys, (F.col("_m") + F.log("_z")).alias("lse"))


def log_softmax_long(logits: DataFrame, keys: list[str] = ["pos"], logit: str = "logit", out: str = "logp") -> DataFrame:  # noqa: B006
    """The long table with the log-softmax of each logit among those of its keys."""
    return logits.join(logsumexp_long(logits, keys, logit), keys).withColumn(out, F.col(logit) - F.col("lse")).drop("lse")


def kl_long(pairs: DataFrame, keys: list[str] = ["pos"], teacher: str = "teacher", student: str = "student") -> DataFrame:  # noqa: B006
    """D2 per position from a long table (keys, vocab_id, teacher, student): ``E_t[t - s] - lse(t) + lse(s)``.

    Both sides go through one exchange of states: as many rows a position as its logits span bins."""
    both = F.array(F.struct(F.lit(0).alias("_side"), F.col(teacher).alias("_x"), (F.col(teacher) - F.col(student)).alias("_d")),
                   F.struct(F.lit(1).alias("_side"), F.col(student).alias("_x"), F.lit(0.0).alias("_d")))
    sides = pairs.select(*keys, F.inline(both))
    s = _states(sides, [*keys, "_side"], "_x", "_d")
    lse = F.col("_m") + F.log("_z")
    t, u = (F.max(F.when(F.col("_side") == i, F.struct(lse.alias("lse"), (F.col("_a") / F.col("_z")).alias("d")))) for i in (0, 1))
    g = s.groupBy(*keys).agg(t.alias("_t"), u.alias("_u"))
    return g.select(*keys, (F.col("_t.d") - F.col("_t.lse") + F.col("_u.lse")).alias("kl"))


# ---- D7 ---------------------------------------------------------------------

class _Softmax:
    """Per position: maxima and max-shifted sums of the teacher's and student's logits seen so far."""

    def __init__(self, n: int):
        self.mt, self.ms = np.full(n, -np.inf), np.full(n, -np.inf)
        self.zt, self.at, self.zs = np.zeros(n), np.zeros(n), np.zeros(n)

    def add(self, lt: np.ndarray, ls: np.ndarray) -> None:
        mt, ms = np.maximum(self.mt, lt.max(axis=1)), np.maximum(self.ms, ls.max(axis=1))
        et, old = np.exp(lt - mt[:, None]), np.exp(self.mt - mt)
        self.zt, self.at = self.zt * old + et.sum(axis=1), self.at * old + (et * (lt - ls)).sum(axis=1)
        self.zs = self.zs * np.exp(self.ms - ms) + np.exp(ls - ms[:, None]).sum(axis=1)
        self.mt, self.ms = mt, ms


class _Tile:
    """A tile of positions: its hidden rows, then weight tiles one after another."""

    def __init__(self) -> None:
        self.parts: dict[int, dict[int, tuple]] = {}  # width tile: position: slices
        self.matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.block = None

    def position(self, pos: int, wide: int, t, s) -> None:
        self.parts.setdefault(wide, {})[pos] = (t, s)

    def _seal(self) -> None:
        self.pos = sorted({p for part in self.parts.values() for p in part})
        for wide, rows in self.parts.items():
            self.matrices[wide] = tuple(np.array([rows[p][side] for p in self.pos]) for side in (0, 1))
        self.parts.clear()
        self.state = _Softmax(len(self.pos))

    def weights(self, block: int, wide: int, t: np.ndarray, s: np.ndarray) -> None:
        """One tile of weight rows and columns: its product is added to the logits of the block."""
        if self.parts:
            self._seal()
        if block != self.block:
            self._merge()
            self.block, self.logits = block, None
        xt, xs = self.matrices[wide]
        part = xt[:, : t.shape[1]] @ t.T, xs[:, : s.shape[1]] @ s.T
        self.logits = part if self.logits is None else (self.logits[0] + part[0], self.logits[1] + part[1])

    def _merge(self) -> None:
        if self.block is not None:
            self.state.add(*self.logits)

    def rows(self) -> pa.RecordBatch | None:
        if self.block is None:
            return None
        self._merge()
        x = self.state
        return pa.RecordBatch.from_arrays([pa.array(self.pos, pa.int64()), *map(pa.array, (x.mt, x.zt, x.at, x.ms, x.zs))], names=["pos", "mt", "zt", "at", "ms", "zs"])


def _stack(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile in order: positions, then weights by vocabulary block and width tile."""
    tile, at, held = _Tile(), None, []

    def flush() -> None:
        if held:
            block, wide = held[0][0]
            tile.weights(block, wide, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]))
            held.clear()

    for b in batches:
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "grp", "side", "block", "wide")]
        steps = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for i, j in zip([0, *steps], [*steps, len(b)]):
            own, side, block, wide = (int(keys[0][i]), int(keys[1][i])), keys[2][i], int(keys[3][i]), int(keys[4][i])
            part = b.slice(i, j - i)
            if own != at:
                flush()
                if (out := tile.rows()) is not None:
                    yield out
                tile, at = _Tile(), own
            t, s = _stack(part.column("t")), _stack(part.column("s"))
            if side == 0:
                for k, p in enumerate(part.column("id").to_pylist()):
                    tile.position(p, wide, t[k], s[k])
            else:
                if held and held[0][0] != (block, wide):
                    flush()
                held.append(((block, wide), t, s))
    flush()
    if (out := tile.rows()) is not None:
        yield out


def product_tiles(hidden: DataFrame, weights: DataFrame, block_rows: int, block_positions: int, width: int, groups: int) -> DataFrame:
    """Rows of both matrices, cut into slices of ``width`` columns and sent to the tiles that need them: a hidden row goes to its
    own tile, once for each of ``groups``; a weight row to every tile."""
    tiles = max(1, -(-hidden.count() // block_positions))

    def cut(df: DataFrame) -> DataFrame:
        wide = F.greatest(F.ceil(F.size("teacher") / width), F.ceil(F.size("student") / width)).cast("int")
        at = F.col("wide") * width + 1
        return df.withColumn("wide", F.explode(F.sequence(F.lit(0), wide - 1))).withColumn("t", F.slice("teacher", at, F.lit(width))).withColumn("s", F.slice("student", at, F.lit(width)))

    x = cut(hidden.withColumn("tile", F.pmod(F.xxhash64("pos"), F.lit(tiles)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    x = x.select("tile", "grp", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("block"), "wide", F.col("pos").cast("long").alias("id"), "t", "s")
    w = cut(weights).withColumn("block", F.expr(f"v div {block_rows}")).withColumn("grp", (F.col("block") % groups).cast("int"))
    w = w.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return x.unionByName(w.select("tile", "grp", F.lit(1).alias("side"), F.col("block").cast("long").alias("block"), "wide", F.col("v").cast("long").alias("id"), "t", "s"))


def projected_kl(hidden: DataFrame, weights: DataFrame, block_rows: int = 4096, block_positions: int = 4096, width: int = 512, groups: int = 1) -> DataFrame:
    """Teacher logits = X_t W_t^T, student logits = X_s W_s^T, then KL per position.

    ``hidden``: (pos, teacher, student), one row a position; ``weights``: (v, teacher, student), each side its own
    matrix, which may differ in width. About ``block_positions`` positions make a tile; a tile's hidden rows are held by one
    task, past which the weights stream in tiles of ``block_rows`` rows and ``width`` columns. Partial logits of the width tiles are
    summed, then a block's logits are merged into the tile's softmax states. So a hidden row is
    moved ``groups`` times, however many weight blocks there are, and a weight row once a tile; memory is one tile of
    positions, one of weights and their logits. ``groups`` > 1 deals the weight blocks of a tile to so
    many tasks, for wide vocabularies and few positions; their states are merged by a ``groupBy``.
    """
    order = ["tile", "grp", "side", "block", "wide", "id"]
    rows = product_tiles(hidden, weights, block_rows, block_positions, width, groups)
    parts = rows.repartition("tile", "grp").sortWithinPartitions(*order).mapInArrow(_tiled, "pos long, mt double, zt double, at double, ms double, zs double")
    g = parts.groupBy("pos").agg(F.max("mt").alias("Mt"), F.max("ms").alias("Ms"), F.collect_list(F.struct("mt", "zt", "at", "ms", "zs")).alias("p"))  # one entry a group
    zt, at, zs = (_rescaled("p", z, m, top) for z, m, top in (("zt", "mt", "Mt"), ("at", "mt", "Mt"), ("zs", "ms", "Ms")))
    return g.select("pos", (at / zt - (F.col("Mt") + F.log(zt)) + (F.col("Ms") + F.log(zs))).alias("kl"))
