"""Wiring of the operators onto the test tables, plus DuckDB oracle SQL.

Each plan module registers ``name -> (spark, sf_dir) -> DataFrame`` and, when
the result is expressible in SQL, the equivalent DuckDB statement.
"""
