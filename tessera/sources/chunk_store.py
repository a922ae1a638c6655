"""S4 for random access: chunks in files that can be found by arithmetic.

Rows lie in the order of a dense number (``chunk_id``, or the place in an epoch, so that a step is a range). File
``p`` holds the numbers of [p * rows_per_file, (p + 1) * rows_per_file), sorted, in a folder of its own, so a
range of numbers names its folders without a listing, and row groups are skipped by their statistics inside a file.
An append is a new segment; the manifest, which names one line a segment, is the commit (``sources.manifest``).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifest import Manifests

EMPTY = {"version": 0, "segments": [], "rows": 0}
FILE = "file"  # the folder column


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", rows_per_file: int = 65_536):
        self.spark, self.root, self.key, self.rows_per_file = spark, root.rstrip("/"), key, rows_per_file
        self.manifests = Manifests(spark, f"{self.root}/manifests", EMPTY)

    def append(self, chunks: DataFrame) -> dict:
        """Add chunks whose numbers follow those of the store without a gap or a repeat; return the manifest.

        One shuffle, by file number: a file is written by one task, whatever the order of arrival. No rows: nothing is
        committed. Numbers that are null, repeated or out of order fail, and the store stays as it was.
        """
        if FILE in chunks.columns:
            raise ValueError(f"the column name {FILE!r} is the store's own")
        state = self.manifests.latest()
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        placed = chunks.withColumn(FILE, F.expr(f"`{self.key}` div {self.rows_per_file}"))
        placed.repartition(F.col(FILE)).sortWithinPartitions(FILE, self.key).write.partitionBy(FILE).parquet(path)
        stored = self.spark.read.schema(chunks.schema).parquet(path)
        found = stored.agg(F.count(F.lit(1)).alias("n"), F.min(self.key).alias("lo"), F.max(self.key).alias("hi"), F.count_distinct(self.key).alias("keys")).first()
        if found.n == 0:
            return state
        first = state["rows"]
        if not (found.n == found["keys"] and found.lo == first and found.hi == first + found.n - 1):
            raise ValueError(f"{self.key} must go on from {first} without a gap or a repeat; found {found.n} rows from {found.lo} to {found.hi}")
        segment = {"path": path, "first": first, "rows": found.n, "rows_per_file": self.rows_per_file}
        now = {"version": self.manifests.next_version(), "segments": [*state["segments"], segment], "rows": first + found.n, "schema": chunks.schema.json()}
        if self.manifests.latest()["version"] != state["version"]:
            raise RuntimeError("another run has extended the store meanwhile")
        self.manifests.commit(now)
        return now

    def read(self, first: int = 0, last: int | None = None, version: int | None = None) -> DataFrame:
        """Chunks with numbers of [first, last) (``last`` None: to the end). Only the files of the range are named to Spark."""
        state = self.manifests.latest() if version is None else self.manifests.load(version)
        if not state or not state["segments"]:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        last = state["rows"] if last is None else min(last, state["rows"])
        out = self.spark.createDataFrame([], schema)
        for s in state["segments"]:
            lo, hi = max(first, s["first"]), min(last, s["first"] + s["rows"])
            if lo >= hi:
                continue
            a, b = lo // s["rows_per_file"], (hi - 1) // s["rows_per_file"]
            whole = (lo, hi) == (s["first"], s["first"] + s["rows"])
            paths = [s["path"]] if whole else [f"{s['path']}/{FILE}={p}" for p in range(a, b + 1)]
            rows = self.spark.read.schema(schema).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])
            out = out.unionByName(rows if whole else rows.where((F.col(self.key) >= lo) & (F.col(self.key) < hi)))
        return out
