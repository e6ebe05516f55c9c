"""Columns that are computed once per row, whatever is asked of them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TEXTS_PER_BATCH = 1000


def bound(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and the named columns, which a later filter cannot push back into their expressions.

    A filter on a projected column is otherwise pushed below the projection with
    the whole expression in it, also into lambdas, where an array would then be
    built again for each of its elements.  A generator stops that.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def text_batches(spark: SparkSession, rows: int = TEXTS_PER_BATCH) -> None:
    """Let an Arrow batch of the session hold ``rows`` rows at most: ten thousand whole texts are too much for a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
