"""tessera: Spark-native data work around language-model distillation.

  sources/    S  scans and sinks (corpora, loss logs, result tables)
  operators/  T  tokenisation, C packing, H chat, L batching, R loss-log
              ranking, G synthetic tasks, E scoring, D metrics, W tensors
  functions/  shared column helpers (hash draws, prefix sums, text rules)
  plans/      wiring of operators onto the test tables + DuckDB oracles
  streaming/  Q  Structured Streaming forms of ranking and chat state
"""

__version__ = "0.1.0"
