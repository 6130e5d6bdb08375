"""The registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with DuckDB SQL for the same rows where there is such."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of graded skill documents by portfolio, gate and grade."""
    return QUERIES["grade_summary"](spark, sf_dir)
