"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``:

1. ``quality``: documents that the byte-level classifier rejects go;
2. ``near_dup``: of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays;
3. ``decontaminate``: documents that hold a benchmark item go;
4. ``pseudonyms``: personal data become format-preserving pseudonyms;
5. ``encode``: of each text its id, SentencePiece ids and digests.

Rows without an id stay where nothing else rejects them; rows that share an id stay or go together in
stage 2. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import decontaminated
from tessera.llm.near_dup import near_duplicates
from tessera.llm.pseudonyms import pseudonymised
from tessera.llm.quality_cnn import quality_scores
from tessera.llm.queries import EXAMPLE_KEY, table, vocabulary
from tessera.llm.sentencepiece_bpe import encode_decode
from tessera.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_scores(spark, docs, table(spark, sf_dir, "labels"), keep=docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(spark, docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymised(docs, EXAMPLE_KEY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(spark, docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_dup", near_dup), ("decontaminate", decontaminate), ("pseudonyms", pseudonyms), ("encode", encode),
]

#: SQL can express neither the classifier nor the encoder; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
