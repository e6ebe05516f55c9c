"""JSON sources: paged grids and area lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import values as val
from vigipanel.operators import quality
from vigipanel.operators.reconcile import reconcile_codes

_PAGE = "status string, rows array<struct<cell: array<string>>>, _corrupt_record string"
_AREA = "id string, nome string, _corrupt_record string"


def grid_pages(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    """Page files as ``path, status, rows``; text that is no JSON has a null status.

    ``multi_line=False`` reads many pages per file, one per line.
    """
    return (
        spark.read.schema(_PAGE).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(paths)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def page_violations(pages: DataFrame) -> DataFrame:
    bad = ~F.col("status").eqNullSafe(F.lit("ok"))
    return quality.violations(
        pages.where(bad), "page_status", F.col("path"), F.concat(F.lit("status="), F.coalesce("status", F.lit("none")))
    )


def grid_rows(pages: DataFrame) -> DataFrame:
    """The named columns of every grid row of every page that is fine."""
    cells = pages.where(F.col("status") == "ok").select(F.explode("rows").alias("r"))
    named = [F.get("r.cell", F.lit(i)).alias(n) for i, n in enumerate(fv.GRID_COLUMNS)]
    return cells.select(*named).withColumn("ano", F.col("ano").try_cast("int"))


def grid_indicators(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Priority indicators of the grid as long rows; providers are not aggregated."""
    keys = [
        "code", "codigo_municipio_snis", "nome_municipio_origem", "uf", "ano", "codigo_prestador",
        "nome_prestador", "sigla_prestador", "abrangencia", "tipo_servico", "natureza_juridica",
    ]
    wide = reconcile_codes(rows, "codigo_municipio_snis", areas, keep_unknown=True)
    codes = [c for c, _, _ in fv.PRIORITY_INDICATORS]
    long = wide.unpivot(keys, codes, "indicator", "_text")
    name = unit = None
    for code, label, measure in fv.PRIORITY_INDICATORS:
        test = F.col("indicator") == code
        name = F.when(test, label) if name is None else name.when(test, label)
        unit = F.when(test, measure) if unit is None else unit.when(test, measure)
    return long.select(
        *keys, "indicator", val.number(F.trim("_text")).alias("value"), name.alias("name"), unit.alias("unit"),
        F.lit(fv.GRID_SOURCE).alias("source"), F.lit(fv.GRID_LEVEL).alias("source_level"),
    )


def area_list(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    """A JSON list of areas as ``code, name``; bad records are for ``list_violations``."""
    parsed = spark.read.schema(_AREA).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(paths)
    return parsed.where(F.col("_corrupt_record").isNull()).select(F.trim("id").alias("code"), F.trim("nome").alias("name"))


def list_violations(spark: SparkSession, paths) -> DataFrame:
    """Files that are no JSON list."""
    texts = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    parsed = F.try_parse_json("value")
    listed = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    return quality.violations(
        texts.where(~listed), "json_list", F.col("path"),
        F.when(parsed.isNull(), F.lit("no valid JSON")).otherwise(F.lit("not a list")),
    )
