"""Operators of a training-data pipeline; their queries are in ``queries``.

Nothing outside this package imports it, except ``__spark_entry__`` and ``corpus_pipeline``.
"""
