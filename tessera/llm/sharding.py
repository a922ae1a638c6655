"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2 ** SLOT_BITS`` equal slots. Virtual nodes of every shard stand in slots drawn by a
hash of (shard, node); a row's key falls into a slot by the hash of its document id and belongs to
the first node at or after it. Loads are bounded by exact quotas of rows (``rows``: counts at most
one apart): all keys try their own shard first, in ring order; those that find it full continue
clockwise to the next shard, and so on until all are placed.

Rows never meet at the driver: it sees one count for each slot, and from those it cuts each slot's
rows into at most ``shards`` runs by their rank in the slot. A rank is the running count of the
cells before (cells hold about ``CELL`` rows, their number follows the table) plus a row number in
the cell. Repeated rows are counted before they are shuffled, so one hot key is one row there.

Null ids are one key like any other; a null text has size 1 and the checksum of the empty text.
Repeated rows get slots of their own, side by side. An empty table gives an empty result. Other
columns of the input are not read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOT_BITS = 12
NODES = 64
CELL = 100_000


def ring(shards: int, nodes: int = NODES, slots: int = 1 << SLOT_BITS) -> dict[int, int]:
    """Shard of each occupied slot. A node whose slot is taken moves on to the next free one."""
    at: dict[int, int] = {}
    for node in range(nodes):
        for shard in range(shards):
            slot = int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:8], "big") % slots
            while slot in at:
                slot = (slot + 1) % slots
            at[slot] = shard
    return at


def clockwise(at: dict[int, int], shards: int, slots: int = 1 << SLOT_BITS) -> list[list[int]]:
    """For each slot all shards in the order in which its keys try them."""
    places = sorted(at)
    order = []
    for slot in range(slots):
        i = bisect.bisect_left(places, slot)
        seen: dict[int, None] = {}
        for k in range(len(places)):
            seen.setdefault(at[places[(i + k) % len(places)]])
            if len(seen) == shards:
                break
        order.append(list(seen))
    return order


def runs(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, first place in the shard) under quotas at most one apart."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    filled = [0] * shards
    order = clockwise(ring(shards), shards)
    placed = dict.fromkeys(counts, 0)
    out = []
    for trial in range(shards):
        for slot in sorted(counts):
            shard = order[slot][trial]
            take = min(counts[slot] - placed[slot], room[shard] - filled[shard])
            if take > 0:
                out.append((slot, placed[slot], placed[slot] + take, shard, filled[shard]))
                placed[slot] += take
                filled[shard] += take
    return out


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", cell_rows: int = CELL) -> DataFrame:
    """Of each row: key, ``size`` (bytes of the text and 1), ``text_crc32``, ``law``, ``shard``, ``slot``
    (place in the shard, gapless from 0), ``home_shard`` (whose node came first), ``grown_shard`` (null under this law)."""
    position = F.shiftrightunsigned(F.xxhash64(F.col(key)), 1)
    counts = {r.slot: r["count"] for r in docs.groupBy(F.shiftright(position, 63 - SLOT_BITS).cast("int").alias("slot")).count().collect()}  # 4096 at most
    plan = runs(counts, shards)
    fine = max(0, (max(counts.values(), default=0) // cell_rows).bit_length())
    rows = docs.select(
        F.col(key).alias("k"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), position.alias("position"))
    rows = rows.groupBy("k", "size", "text_crc32", "position").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("cell", F.shiftright("position", 63 - SLOT_BITS - fine))
    cells = docs.groupBy(F.shiftright(position, 63 - SLOT_BITS - fine).alias("cell")).agg(F.count("*").alias("n"))
    ring_slot = F.shiftright("cell", fine).cast("int")
    before = Window.partitionBy(ring_slot).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("cell").orderBy("position", "k", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("rank", F.coalesce(F.sum("copies").over(inner), F.lit(0))).join(cells, "cell")
            .withColumn("rank", F.explode(F.sequence(F.col("base") + F.col("rank"), F.col("base") + F.col("rank") + F.col("copies") - 1))))
    order = clockwise(ring(shards), shards)
    parts = spark.createDataFrame([(*r, order[r[0]][0]) for r in plan], "ring_slot int, first long, last long, shard int, place long, home_shard int")
    rows = rows.withColumn("ring_slot", ring_slot).alias("a").join(
        F.broadcast(parts.alias("b")),  # at most 4096 slots of `shards` runs each
        F.expr("a.ring_slot = b.ring_slot and a.rank >= b.first and a.rank < b.last"))
    return rows.select(F.col("k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                       (F.col("place") + F.col("rank") - F.col("first")).alias("slot"), "home_shard", F.lit(None).cast("int").alias("grown_shard"))
