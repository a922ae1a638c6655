"""Chunk-table and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_chunks(chunks: DataFrame, root: str, chunk_len: int, max_records_per_file: int = 1_000_000,
                 mode: str = "overwrite") -> str:
    """Chunks go under ``{root}/chunked_context{C}``; files are capped by
    ``maxRecordsPerFile`` so no single writer task produces a huge file."""
    path = f"{root.rstrip('/')}/chunked_context{int(chunk_len)}"
    (chunks.write.mode(mode).option("maxRecordsPerFile", max_records_per_file).parquet(path))
    return path


def result_name(model: str, task: str, **params) -> str:
    """Output stem from model, task and parameters; ``/`` -> ``_``, ``.`` -> ``p``."""
    parts = [model.replace("/", "_"), task] + [f"{k}{v}" for k, v in params.items()]
    return "_".join(str(p) for p in parts).replace(".", "p")


def write_results(baseline: DataFrame, per_layer: DataFrame, out_dir: str, stem: str) -> dict:
    """Baseline record -> JSON, per-layer table -> CSV with header, no index.

    Both inputs are small result tables (one row per run/layer); ``coalesce(1)``
    gives one file each without a shuffle.
    """
    base_path = f"{out_dir.rstrip('/')}/{stem}_baseline"
    layer_path = f"{out_dir.rstrip('/')}/{stem}_layers"
    baseline.coalesce(1).write.mode("overwrite").json(base_path)
    per_layer.coalesce(1).write.mode("overwrite").option("header", True).csv(layer_path)
    return {"baseline": base_path, "layers": layer_path}
