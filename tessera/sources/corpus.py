"""Corpus scans, first-N, column keep/drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str, text_col: str = "text",
                id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Load a corpus and fail early when the text column is absent.

    Only ``id_col``, ``text_col`` and ``keep`` are selected, so the Parquet
    scan reads just those columns (``ReadSchema`` in the plan).
    """
    df = spark.read.parquet(path)
    check_text_column(df, text_col)
    if id_col not in df.columns:
        raise ValueError(f"Order key '{id_col}' not found. Available columns: {df.columns}")
    cols = [id_col, text_col] + [c for c in (keep or []) if c not in (id_col, text_col)]
    return df.select(*cols)


def check_text_column(df: DataFrame, text_col: str) -> None:
    if text_col not in df.columns:
        raise ValueError(f"Column '{text_col}' not found in dataset. Available columns: {df.columns}")


def take_first(df: DataFrame, n: int | None, order_key) -> DataFrame:
    """First ``min(n, count)`` rows by ``order_key``; ``None``/0 keeps all.

    ``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: a per-partition
    top-n and one merge of n rows, never a full sort.
    """
    if not n:
        return df
    keys = order_key if isinstance(order_key, (list, tuple)) else [order_key]
    return df.orderBy(*keys).limit(int(n))

