"""A keyed table that a stream updates: log-structured, merged in levels, committed by manifests.

Each batch adds one segment (Parquet, by blocks of the key space). ``fan`` segments of a level are merged into one of
the next level, where only the newest row of a key stays; so n batches leave at most ``fan`` segments a level and about
log n levels, and a row is rewritten once a level. A manifest names the segments and the last epoch: a batch that is
run again finds its epoch there and changes nothing. Segments that a merge replaced are deleted ``retain`` versions later,
so a reader of a recent version still finds its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.manifest import Manifests

EMPTY = {"version": 0, "epoch": -1, "levels": [], "dropped": []}


class StateTable:
    """``schema``: columns of a row; ``keys`` name a row, the largest ``order`` (then the latest epoch) wins; ``block``
    is the column that the folders follow. The names ``_epoch`` and ``_s`` are the table's own."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], block: str, order: str | None = None, fan: int = 8, retain: int = 4):
        self.spark, self.root, self.keys, self.block, self.order, self.fan, self.retain = spark, root.rstrip("/"), keys, block, order, fan, retain
        self.schema = T.StructType.fromDDL(schema)
        self.manifests = Manifests(spark, f"{self.root}/manifests", EMPTY)

    def epoch(self) -> int:
        """The last epoch that counts; -1: none."""
        return self.manifests.latest()["epoch"]

    def _segments(self, paths: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_epoch", T.LongType())])
        out = self.spark.createDataFrame([], schema)
        for path in paths:  # each is the root of its own block folders
            out = out.unionByName(self.spark.read.schema(schema).parquet(path))
        return out

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row a key, by partial aggregation: a hot key combines before the shuffle."""
        names = [f.name for f in self.schema if f.name not in self.keys]
        by = F.struct(*([self.order] if self.order else []), "_epoch")
        found = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names, "_epoch"), by).alias("_s"))
        return found.select(*self.keys, "_s.*")

    def read(self, blocks: list | None = None, state: dict | None = None) -> DataFrame:
        """The newest row of each key; ``blocks`` reads the folders of these alone."""
        state = state or self.manifests.latest()
        rows = self._segments([s for level in state["levels"] for s in level])
        if blocks is not None:
            rows = rows.where(F.col(self.block).isin(blocks))
        return self._newest(rows).select(*self.schema.names)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        rows.repartition(F.col(self.block)).write.partitionBy(self.block).option("maxRecordsPerFile", 5_000_000).parquet(path)
        return path

    def merge(self, rows: DataFrame, epoch: int) -> bool:
        """Add a batch's rows; False where this epoch counts already."""
        state = self.manifests.latest()
        if epoch <= state["epoch"]:
            return False
        levels = [list(level) for level in state["levels"]] or [[]]
        levels[0].append(self._write(self._newest(rows.select(*self.schema.names).withColumn("_epoch", F.lit(epoch).cast("long")))))
        dropped, version = list(state["dropped"]), self.manifests.next_version()
        for i in range(len(levels)):
            if len(levels[i]) < self.fan:
                break
            if i + 1 == len(levels):
                levels.append([])
            levels[i + 1].append(self._write(self._newest(self._segments(levels[i]))))
            dropped += [[version, path] for path in levels[i]]
            levels[i] = []
        old = [path for v, path in dropped if v <= version - self.retain]
        self.manifests.commit({"version": version, "epoch": epoch, "levels": levels, "dropped": [d for d in dropped if d[1] not in old]})
        for path in old:
            self.manifests.drop(path)
        self.manifests.forget(version - self.retain + 1)
        return True
