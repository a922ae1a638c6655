"""C5 for a corpus that grows: tokens with global offsets in a folder, extended by what is new.

A store is a folder of segments (Parquet, one a sync) and numbered manifests. A manifest names the segments
that count, the tokens and documents before each, and a checksum of all texts so far; it is the only thing
that is committed (``sources.manifest``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pack
from .manifest import Manifests

EMPTY = {"version": 0, "segments": [], "docs": 0, "tokens": 0, "checksum": [0, 0], "last_key": None}


class TokenStore:
    """``encode`` maps documents (key, text) to tokens (key, ``input_ids``) and must give a text the same ids every time, so its
    vocabulary is fixed by the caller. Keys are unique numbers or strings that grow: a new document's key is
    larger than all before it."""

    def __init__(self, spark: SparkSession, root: str, encode: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text"):
        self.spark, self.root, self.encode, self.key, self.text = spark, root.rstrip("/"), encode, key, text
        self.manifests = Manifests(spark, f"{self.root}/manifests", EMPTY)

    # ---- manifests ----

    def manifest(self, version: int | None = None) -> dict:
        """The state of a version, or the latest whole one."""
        if version is None:
            return self.manifests.latest()
        return self.manifests.load(version) if version else dict(EMPTY)

    # ---- growth ----

    def _checked(self, docs: DataFrame, state: dict) -> None:
        n, a, b = pack.corpus_fingerprint(docs, self.key, self.text).first()
        if [n, int(a), int(b)] != [state["docs"], *state["checksum"]]:
            raise ValueError(f"documents up to {state['last_key']!r} are not those that the store was made from; build a new store")

    def sync(self, docs: DataFrame) -> dict:
        """Bring the store up to ``docs``, the whole corpus of now, and return its manifest.

        Documents up to the last key are only read for their checksum, which must be the stored one; those after it are
        tokenised, and placed after the stored tokens by a running sum over themselves. Nothing new: nothing written.
        """
        docs = docs.select(self.key, self.text)
        state = self.manifest()
        new = docs
        if state["last_key"] is not None:
            self._checked(docs.where(F.col(self.key) <= F.lit(state["last_key"])), state)
            new = docs.where((F.col(self.key) > F.lit(state["last_key"])) | F.col(self.key).isNull())
        n, a, b = pack.corpus_fingerprint(new, self.key, self.text).first()
        if n == 0:
            return state
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        offsets = pack.token_offsets(self.encode(new), self.key)
        offsets.withColumn("start", F.col("start") + F.lit(state["tokens"])).write.parquet(path)
        rows = self.spark.read.parquet(path).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max(self.key).alias("last"), F.count_distinct(self.key).alias("keys")).first()
        if not rows.n == n == rows["keys"]:
            raise ValueError(f"{self.key} is not unique")
        segment = {"path": path, "docs": state["docs"], "tokens": state["tokens"]}
        now = {"version": self.manifests.next_version(), "segments": [*state["segments"], segment], "docs": state["docs"] + n, "tokens": state["tokens"] + rows.t,
               "checksum": [state["checksum"][0] + int(a), state["checksum"][1] + int(b)], "last_key": rows["last"], "before": state["version"]}
        if self.manifest()["version"] != state["version"]:
            raise RuntimeError("another run has extended the store meanwhile")
        self.manifests.commit(now)
        return now

    def read(self, version: int | None = None) -> DataFrame:
        """Tokens with ``n_tokens`` and ``start`` of a version; the latest where none is named."""
        state = self.manifest(version)
        if not state["segments"]:
            raise ValueError("the store is empty")
        return self.spark.read.parquet(*[s["path"] for s in state["segments"]])

    def new_chunks(self, chunk_len: int, since: int) -> DataFrame:
        """The chunks that the corpus has now and had not at version ``since``: whole chunks never change, so packing begins at
        the one that was incomplete then, from the documents that reach into it."""
        first = self.manifest(since)["tokens"] // chunk_len
        tail = self.read().where(F.col("start") + F.col("n_tokens") > F.lit(first * chunk_len))
        return pack.pack_chunks(tail, chunk_len).where(F.col("chunk_id") >= first)
