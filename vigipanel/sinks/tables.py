"""Materialisation: staged loads, guarded appends, exports and publication."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigipanel import fixed_values as fv
from vigipanel.operators import quality
from vigipanel.session import cut_lineage, fresh_path
from vigipanel.sinks.versions import write_once


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("_ingested_at", F.current_timestamp())


def load_table(df: DataFrame, table: str, checks: list[DataFrame] = (), partition_by: list[str] = ()) -> str:
    """Replace a table all or nothing; returns the folder of the new data.

    The data go to a fresh folder of the shared storage; the gates look at what
    was written, and only then the table name is pointed at it.  A failed write
    or gate leaves the old table as it was.  A check is a frame of violations,
    or a function from the written frame to one.
    """
    spark = df.sparkSession
    path = fresh_path(spark, table.replace(".", "-"))
    stamped(df).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    for check in checks:
        quality.enforce(check(spark.read.parquet(path)) if callable(check) else check)
    point_table(spark, table, path)
    return path


def load_tables(frames: dict[str, DataFrame], checks: list[DataFrame] = ()) -> dict[str, str]:
    """Several tables: all data are written before the first name is moved."""
    for check in checks:
        quality.enforce(check)
    paths = {}
    for table, df in frames.items():
        path = fresh_path(df.sparkSession, table.replace(".", "-"))
        stamped(df).write.mode("errorifexists").parquet(path)
        paths[table] = path
    for table, path in paths.items():
        point_table(frames[table].sparkSession, table, path)
    return paths


def point_table(spark: SparkSession, table: str, path: str) -> None:
    """Point a name at a folder; one step where the table exists with the same columns."""
    new = spark.read.parquet(path)
    if spark.catalog.tableExists(table) and spark.table(table).dtypes == new.dtypes and not _is_partitioned(spark, table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
        return
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.catalog.createTable(table, path=path, source="parquet")
    if spark.read.parquet(path).schema.names and _is_partitioned(spark, table):
        spark.catalog.recoverPartitions(table)


def _is_partitioned(spark: SparkSession, table: str) -> bool:
    return any(c.isPartition for c in spark.catalog.listColumns(table))


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def append_run(run: DataFrame, path: str) -> int:
    """Append one complete run; refuses bad payloads and an id already stored.

    Each run is a partition folder of its own that is made visible by one rename,
    so of two writers of the same id one is refused, also if both came at once.
    """
    quality.enforce(quality.required_columns(run, [n for n, _ in fv.RUN_COLUMNS]))
    typed = cut_lineage(run.select(*[F.col(n).cast(t).alias(n) for n, t in fv.RUN_COLUMNS]))
    quality.enforce(quality.run_payload(typed))
    nulls = None
    for name, _ in fv.RUN_COLUMNS:
        nulls = F.col(name).isNull() if nulls is None else nulls | F.col(name).isNull()
    quality.enforce(quality.violations(typed.where(nulls), "run_null", F.col("tempo").cast("string"), "null value"))
    key = typed.select("execution_id").first()[0]          # the gate above has found exactly one
    if not write_once(stamped(typed), path, "run_key", key):
        raise quality.QualityError(f"run_stored: {key} is already stored")
    return typed.count()


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def publish_aggregates(tables: dict[str, DataFrame], allowed: tuple[str, ...], forbidden: tuple[str, ...],
                       folder: str, criterion_table: str) -> list[str]:
    """Copy the allowed aggregate tables to a new folder; event-level tables never go.

    The one territorial criterion is asserted on the data before anything is written.
    """
    missing = sorted(set(allowed) - set(tables))
    if missing:
        raise quality.QualityError(f"aggregate tables missing: {missing}")
    event_level = sorted(set(allowed) & set(forbidden))
    if event_level:
        raise quality.QualityError(f"event-level tables must not be published: {event_level}")
    quality.enforce(quality.value_domain(
        tables[criterion_table], "area_criterion", [fv.AGGREGATE_CRITERION], exact=True, rule="publish_criterion"
    ))
    for name in allowed:
        tables[name].write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")
    return list(allowed)


def metadata_row(spark: SparkSession, values: dict, columns: tuple[str, ...]) -> DataFrame:
    """One text row in the fixed order; objects as JSON, null as ''."""
    unknown = sorted(set(values) - set(columns))
    if unknown:
        raise quality.QualityError(f"unknown metadata fields: {unknown}")

    def text(value):
        if value is None:
            return ""
        return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)

    schema = ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([tuple(text(values.get(c, "")) for c in columns)], schema)


METADATA_TABLES = {
    "dicionario_coleta": fv.COLLECTION_COLUMNS, "dicionario_calculos": fv.CALCULATION_COLUMNS,
    "dicionario_variaveis": fv.VARIABLE_COLUMNS, "controle_arquivos": fv.FILE_CONTROL_COLUMNS,
}


def initialise_metadata(spark: SparkSession, folder: str) -> list[str]:
    """Create the dictionaries that do not exist yet; returns those created."""
    created = []
    for name, columns in METADATA_TABLES.items():
        path = f"{folder.rstrip('/')}/{name}"
        if existing(spark, path) is None:
            empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
            empty.write.mode("errorifexists").parquet(path)
            created.append(name)
    return created


def append_metadata(spark: SparkSession, folder: str, table: str, values: dict) -> None:
    row = metadata_row(spark, values, METADATA_TABLES[table])
    row.write.mode("append").parquet(f"{folder.rstrip('/')}/{table}")


def insert_version(spark: SparkSession, path: str, version: str) -> bool:
    """Insert a schema version once; false when it was there."""
    row = spark.createDataFrame([(version,)], "version string").withColumn("applied_at", F.current_timestamp())
    return write_once(row, path, "version_key", version)
