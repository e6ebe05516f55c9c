"""Area codes, regions and indicator codes brought to one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import indicators as ind, text as tx


def short_codes(areas: DataFrame, digits: int = 6) -> DataFrame:
    """Prefix to full code; check ``quality.unique_key`` on ``code6`` first."""
    return areas.select(F.left("code", F.lit(digits)).alias("code6"), F.col("code").alias("code"))


def reconcile_codes(df: DataFrame, column: str, areas: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Adds the full ``code`` for a six-digit residence code.

    Unknown codes are dropped (records from elsewhere) or kept with null.
    """
    how = "left" if keep_unknown else "inner"
    keyed = df.withColumn("code6", F.trim(F.col(column)))
    return keyed.join(short_codes(areas), "code6", how).drop("code6")


def passthrough_codes(df: DataFrame, column: str, areas: DataFrame) -> DataFrame:
    """Seven digits pass as they are, six are looked up; the rest stays null."""
    source = tx.strip_decimal_tail(tx.clean_text(column))
    keyed = df.withColumn("source_code", source).withColumn("code6", F.left("source_code", F.lit(6)))
    found = keyed.join(short_codes(areas).withColumnRenamed("code", "_full"), "code6", "left")
    return found.withColumn(
        "code", F.when(F.length("source_code") == 7, F.col("source_code")).otherwise(F.col("_full"))
    ).drop("code6", "_full")


def members_of(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str) -> DataFrame:
    """Rows whose value occurs in ``allowed``."""
    return df.join(allowed.select(F.col(allowed_column).alias(column)).distinct(), column, "left_semi")


def area_dimension(areas: DataFrame, regions: DataFrame, state: str = "RJ", state_code: str = "33") -> DataFrame:
    """Areas with valid codes joined to their region on the normalised name.

    ``areas``: ``code, name``; ``regions``: ``area_name, region_code, region``.
    Areas without a region keep nulls, which ``quality`` reports.
    """
    named = areas.where(ind.valid_area_code("code", state_code)).select(
        F.trim(F.col("code").cast("string")).alias("code"), F.trim("name").alias("name"),
        tx.normalise_name("name").alias("normalised_name"),
    )
    known = regions.select(tx.normalise_name("area_name").alias("normalised_name"), "region_code", "region")
    return named.join(known, "normalised_name", "left").select(
        "code", "name", "normalised_name", F.lit(state).alias("state"),
        F.lit(state_code).alias("state_code"), "region_code", "region",
    )


def comparability(spark: SparkSession) -> DataFrame:
    """Decision table of the priority indicators: six fixed rows."""
    return spark.createDataFrame(
        list(fv.COMPARABILITY), "component string, legacy_code string, current_code string, comparability string"
    )


def harmonised(indicators: DataFrame, decisions: DataFrame) -> DataFrame:
    """Standard code (directly comparable pairs only) and comparability of each row.

    Both the legacy and the current code of a pair lead to the current code.
    """
    both = decisions.select(
        F.explode(F.array("legacy_code", "current_code")).alias("indicator"),
        F.when(F.col("comparability") == fv.DIRECTLY_COMPARABLE, F.col("current_code")).alias("standard_code"),
        "comparability",
    )
    return indicators.join(both, "indicator", "left").withColumn(
        "comparability", F.coalesce("comparability", F.lit(fv.NOT_EVALUATED))
    )


def aligned_columns(df: DataFrame, columns: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """The canonical column list in order; a missing column is ''."""
    defaults = defaults or {}
    present = set(df.columns)
    return df.select(*[
        F.col(c) if c in present else F.lit(defaults.get(c, "")).alias(c) for c in columns
    ])


def information_crosswalk(table: DataFrame) -> DataFrame:
    """Crosswalk rows with their codes and class.

    ``table``: ``group, legacy_code, reference, description, expression,
    current_description, comments``; rows without a legacy code are dropped.
    """
    flat = table.select(*[tx.flatten_space(c).alias(c) for c in table.columns])
    return (
        flat.where(F.col("legacy_code") != "")
        .withColumn("current_codes", tx.joined_codes("expression"))
        .withColumn("correspondence", tx.correspondence_class("expression"))
        .withColumn("has_comment", F.col("comments") != "")
    )
