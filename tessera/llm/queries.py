"""The thin ``opN_`` queries and their SQL; each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A public vocabulary file, read by the driver and sent to the tasks as bytes."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm_score import lm_scores

    return lm_scores(spark, table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_bpe import encode_decode

    return encode_decode(spark, table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return (token_counts(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
            .withColumn("over_limit", F.col("n_tokens") > 2048))


@query
def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import license_scan

    return license_scan(spark, table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_cnn import quality_scores

    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The secret of the pseudonyms is a parameter; this one serves the queries over synthetic tables.
EXAMPLE_KEY = b"an example key, not a secret"


@query
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pseudonyms import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents"), EXAMPLE_KEY, count="n_replaced")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contaminated

    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_rows

    return shard_rows(spark, table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.conversation_repair import repaired_conversations

    return repaired_conversations(spark, table(spark, sf_dir, "conversations"))


@query
def op12_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.vector_dup import vector_duplicates

    return vector_duplicates(spark, table(spark, sf_dir, "embeddings"))


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.centroids import clustered

    return clustered(spark, table(spark, sf_dir, "embeddings"))


def _oracles() -> None:
    from tessera.llm import centroids, conversation_repair, licenses, quality_rules, vector_dup

    ORACLE["op2_licenses"] = licenses.oracle_sql()
    ORACLE["op9_quality_rules"] = quality_rules.oracle_sql()
    ORACLE["op11_conversation_repair"] = conversation_repair.oracle_sql()
    ORACLE["op12_vector_dup"] = vector_dup.oracle_sql()
    ORACLE["op13_centroids"] = centroids.oracle_sql()


_oracles()
