"""Queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigipanel.llm.bound import text_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COMPARISON: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame``; ``table(name)`` reads a table of the folder."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            text_batches(spark)
            return fn(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            COMPARISON[name] = sql
        return fn

    return register
