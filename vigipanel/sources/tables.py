"""Typed scans: fixed contracts, codes as text, unions, attributes from file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from vigipanel import fixed_values as fv
from vigipanel.functions import indicators as ind
from vigipanel.operators import quality


def typed_csv(spark: SparkSession, paths, schema: str | StructType, delimiter: str = ",",
              encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and a fixed schema; nothing is inferred, codes stay text."""
    return (
        spark.read.schema(schema).option("header", True).option("sep", delimiter)
        .option("encoding", encoding).option("enforceSchema", False).csv(paths)
    )


def record_scan(spark: SparkSession, paths, areas: DataFrame, year: int | None = None) -> DataFrame:
    """National record files (Latin-1, all text) cut to the areas and to safe columns.

    The base year is the argument, or the four digits of the file name.  Splits
    of the files replace a chunk loop; filter and projection run in the scan.
    """
    raw = (
        spark.read.option("header", True).option("encoding", "ISO-8859-1")
        .option("enforceSchema", False)      # a file with other columns fails instead of shifting
        .csv(paths)
    )
    return residents_only(raw.withColumn("_file", F.col("_metadata.file_name")), areas, year)


def residents_only(raw: DataFrame, areas: DataFrame, year: int | None = None) -> DataFrame:
    """Records of residents of the areas, safe columns only."""
    from vigipanel.operators.reconcile import reconcile_codes

    quality.enforce(quality.required_columns(raw, fv.SAFE_COLUMNS))
    base_year = F.lit(year) if year is not None else F.regexp_extract("_file", r"(\d{4})", 1).try_cast("int")
    kept = raw.withColumn("_base_year", base_year).select("_base_year", *fv.SAFE_COLUMNS)
    matched = reconcile_codes(kept.withColumn(fv.RESIDENCE_COLUMN, F.trim(fv.RESIDENCE_COLUMN)), fv.RESIDENCE_COLUMN, areas)
    return matched.select(
        F.col("_base_year").alias("base_year"), F.lit(fv.RECORD_CRITERION).alias("criterion"),
        "code", *fv.SAFE_COLUMNS,
    )


def staged_records(safe: DataFrame) -> DataFrame:
    """Safe columns under the names ``operators.series.typed_records`` expects."""
    return safe.select(
        "code", "base_year", F.col(fv.RESIDENCE_COLUMN).alias("residence_code"),
        F.col("DT_SIN_PRI").alias("symptom_date"), F.col("DT_NOTIFIC").alias("notification_date"),
        F.col("SEM_PRI").alias("symptom_week"), F.col("CLASSI_FIN").alias("class_code"),
    )


def union_sources(*frames: DataFrame, fill: str | None = "") -> DataFrame:
    """One relation of several; a column a source lacks is ''."""
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return joined.fillna(fill) if fill is not None else joined


def year_month_of_name(name, prefix: str = ""):
    """Year and month from ``<prefix>YYYY_MM`` in a file name; null when absent."""
    pattern = rf"{prefix}(\d{{4}})_(\d{{2}})"
    col = F.col(name) if isinstance(name, str) else name
    return (
        F.regexp_extract(col, pattern, 1).try_cast("int").alias("year"),
        F.regexp_extract(col, pattern, 2).try_cast("int").alias("month"),
    )


def system_of_name(name):
    col = F.col(name) if isinstance(name, str) else name
    return F.when(col.startswith("sinisa_"), fv.CURRENT_SYSTEM).otherwise(fv.LEGACY_SYSTEM)


def component_of_name(name, code):
    """Component from the file name, else from the indicator code."""
    col = F.col(name) if isinstance(name, str) else name
    return (
        F.when(col.contains("residuos_solidos"), fv.WASTE)
        .when(col.contains("aguas_pluviais"), fv.STORMWATER)
        .otherwise(ind.fact_component(code))
    )


def missing_tables(spark: SparkSession, required) -> list[str]:
    """Names the catalog does not hold."""
    return sorted(t for t in required if not spark.catalog.tableExists(t))
