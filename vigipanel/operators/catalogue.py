"""Indicator catalogue: metadata variants, versions, ids, harmonisation status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import text as tx

ATTRIBUTES = ["system", "component", "indicator", "name", "unit", "family", "formula"]


def metadata_variants(indicators: DataFrame) -> DataFrame:
    """Distinct attribute sets with their first and last year; nulls are values."""
    return indicators.groupBy(*ATTRIBUTES).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def inventory(variants: DataFrame, decisions: DataFrame) -> DataFrame:
    """Versions within (system, component, code) by first year, ids, and status.

    All six decided pairs give a standard code here, but only to rows of the
    legacy system.
    """
    key = ["system", "component", "indicator"]
    rest = ["name", "unit", "family", "formula", "last_year"]
    filled = variants.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ATTRIBUTES], "first_year", "last_year"
    ).distinct()
    order = Window.partitionBy(*key).orderBy("first_year", *rest)
    versioned = filled.withColumn("version", tx.version_label(F.row_number().over(order)))
    decided = decisions.select(
        F.lit(fv.LEGACY_SYSTEM).alias("system"), "component", F.col("legacy_code").alias("indicator"),
        F.col("current_code").alias("_standard"), F.col("comparability").alias("_status"),
    )
    default = F.when(
        F.col("component").isin(fv.WATER, fv.SEWER), fv.HARMONISATION_WATER_SEWER
    ).otherwise(fv.HARMONISATION_OTHER)
    return (
        versioned.join(decided, key, "left")
        .select(
            tx.composite_id("system", "component", "indicator", "version").alias("id"),
            *ATTRIBUTES, "first_year", "last_year", "version",
            F.coalesce("_standard", F.lit("")).alias("standard_code"),
            F.coalesce("_status", default).alias("harmonisation"),
        )
    )
