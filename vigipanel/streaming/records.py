"""Incremental record ingestion: the batch operators over new files only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigipanel.operators.series import day_counts, typed_records
from vigipanel.sources.tables import residents_only, staged_records


def _each_batch(spark: SparkSession, folder: str, areas: DataFrame, target: str, checkpoint: str, year: int | None,
                files_per_batch: int, shape: Callable[[DataFrame], DataFrame]):
    """Write ``shape`` of the typed fact of each micro-batch to its own folder ``batch=<n>``.

    The stream's own checkpoint remembers the files.  A batch repeated after a
    failure has the same files and the same number, so it replaces its folder
    instead of counting twice.
    """
    layout = spark.read.option("header", True).csv(folder).schema      # names only, all text
    raw = (
        spark.readStream.schema(layout).option("header", True).option("encoding", "ISO-8859-1")
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch).csv(folder)
        .withColumn("_file", F.col("_metadata.file_name"))
    )

    def write(batch: DataFrame, number: int) -> None:
        fact = typed_records(staged_records(residents_only(batch, areas, year)), first_text_dates=True)
        shape(fact).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_new_files(spark: SparkSession, folder: str, areas: DataFrame, target: str, checkpoint: str,
                     year: int | None = None, files_per_batch: int = 100):
    """Process the record files not seen before and append the typed fact."""
    return _each_batch(spark, folder, areas, target, checkpoint, year, files_per_batch, lambda fact: fact)


def count_new_files(spark: SparkSession, folder: str, areas: DataFrame, target: str, checkpoint: str,
                    year: int | None = None, files_per_batch: int = 100):
    """Keep partial counts (``series.day_counts``) of the record files not seen before; no record is stored."""
    return _each_batch(spark, folder, areas, target, checkpoint, year, files_per_batch, day_counts)


def counts_so_far(spark: SparkSession, target: str) -> DataFrame:
    """The partial counts of all batches, added up; the series take them in place of records."""
    return day_counts(spark.read.parquet(target))
