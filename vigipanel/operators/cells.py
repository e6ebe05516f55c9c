"""Header-block sheets as cell tables ``file, sheet, row, col, value``.

Rows and columns count from 0.  Header rows, columns by code, merged family
headers and positional layouts become joins within (file, sheet), so any number
of sheets is one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import text as tx, values as val

SHEET = ["file", "sheet"]


def cleaned(cells: DataFrame) -> DataFrame:
    return cells.select(*SHEET, "row", "col", tx.clean_text("value").alias("value"))


def header_with_token(cells: DataFrame, token: str, within: int = 20) -> DataFrame:
    """First row of each sheet that holds the token."""
    return (
        cleaned(cells).where((F.col("row") < within) & (F.col("value") == token))
        .groupBy(*SHEET).agg(F.min("row").alias("header_row"))
    )


def header_with_most_codes(cells: DataFrame, pattern: str = fv.CURRENT_CODE_PATTERN, within: int = 20) -> DataFrame:
    """Row with the most indicator codes, the first one on ties."""
    counted = (
        cleaned(cells).where(F.col("row") < within)
        .groupBy(*SHEET, "row").agg(F.count_if(F.col("value").rlike(f"^(?:{pattern})$")).alias("_codes"))
    )
    return counted.groupBy(*SHEET).agg(F.min_by("row", F.struct(-F.col("_codes"), F.col("row"))).alias("header_row"))


def first_code_row(cells: DataFrame, pattern: str = fv.LEGACY_CODE_PATTERN, within: int = 15) -> DataFrame:
    return (
        cleaned(cells).where((F.col("row") < within) & F.col("value").rlike(f"^(?:{pattern})$"))
        .groupBy(*SHEET).agg(F.min("row").alias("header_row"))
    )


def first_numeric_row(cells: DataFrame, headers: DataFrame, col: int = 0) -> DataFrame:
    """First row below the header whose first cell is a number."""
    below = cleaned(cells).where(F.col("col") == col).join(headers, SHEET).where(F.col("row") > F.col("header_row"))
    numeric = below.where(val.number("value").isNotNull())
    return numeric.groupBy(*SHEET).agg(F.min("row").alias("data_row"))


def columns_by_code(cells: DataFrame, headers: DataFrame, token: str) -> DataFrame:
    """Column of a header code per sheet and how often it occurs (must be 1)."""
    return (
        cleaned(cells).join(headers, SHEET)
        .where((F.col("row") == F.col("header_row")) & (F.col("value") == token))
        .groupBy(*SHEET).agg(F.min("col").alias("column"), F.count(F.lit(1)).alias("matches"))
    )


def filled_across(cells: DataFrame) -> DataFrame:
    """Merged headers: an empty cell takes the last value to its left."""
    order = Window.partitionBy(*SHEET, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(tx.clean_text("value") != "", F.col("value"))
    return cells.withColumn("value", F.last(held, ignorenulls=True).over(order))


@dataclass(frozen=True)
class Layout:
    """Where a kind of sheet keeps what, as offsets from its header row."""

    component: str
    year: int
    state_col: int
    code_col: int
    name_col: int
    name_offset: int
    unit_offset: int
    data_offset: int = 1
    family_offset: int | None = None
    formula_offset: int | None = None
    family_merged: bool = False
    provider_name_col: int | None = None
    provider_acronym_col: int | None = None
    provider_scope_col: int | None = None
    response_col: int | None = None
    pattern: str = fv.CURRENT_CODE_PATTERN
    source: str = "SINISA/Ministério das Cidades"


def indicator_rows(cells: DataFrame, headers: DataFrame, layout: Layout, state: str = "RJ",
                   data_rows: DataFrame | None = None) -> DataFrame:
    """Long indicator rows of all sheets of one layout.

    ``headers``: header row per sheet; ``data_rows``: first data row where it
    does not simply follow the header.
    """
    # a cell left out of a sparse table is an empty cell: add it for every data row
    at = cleaned(cells).join(headers, SHEET)
    codes = at.where((F.col("row") == F.col("header_row")) & F.col("value").rlike(f"^(?:{layout.pattern})$"))
    columns = codes.select(*SHEET, "col", "header_row", F.col("value").alias("indicator"))

    def header_cell(source: DataFrame, offset: int | None, name: str) -> DataFrame:
        row = F.greatest(F.col("header_row") + F.lit(offset), F.lit(0))
        return source.where(F.col("row") == row).select(*SHEET, "col", F.col("value").alias(name))

    described = columns
    for name, offset in (("name", layout.name_offset), ("unit", layout.unit_offset),
                         ("formula", layout.formula_offset)):
        if offset is None:
            described = described.withColumn(name, F.lit(""))
        else:
            described = described.join(header_cell(at, offset, name), [*SHEET, "col"], "left")
    if layout.family_offset is None:
        described = described.withColumn("family", F.col("sheet"))
    else:
        row = F.greatest(F.col("header_row") + F.lit(layout.family_offset), F.lit(0))
        source = at.where(F.col("row") == row)
        if layout.family_merged:
            # unfold to every code column first: sparse tables lack the merged cells
            every = columns.select(*SHEET, "col").withColumn("row", F.lit(-1)).withColumn("value", F.lit(""))
            held = source.select(*SHEET, "col", "row", "value").unionByName(every)
            order = Window.partitionBy(*SHEET).orderBy("col", F.col("row").desc()).rowsBetween(Window.unboundedPreceding, 0)
            text = F.last(F.when(F.col("value") != "", F.col("value")), ignorenulls=True).over(order)
            family = held.withColumn("family", text).where(F.col("row") == -1).select(*SHEET, "col", "family")
        else:
            family = source.select(*SHEET, "col", F.col("value").alias("family"))
        described = described.join(family, [*SHEET, "col"], "left")

    below = at
    if data_rows is None:
        below = below.where(F.col("row") >= F.col("header_row") + layout.data_offset)
    else:
        below = below.join(data_rows, SHEET).where(F.col("row") >= F.col("data_row"))
    wanted = {
        "_state": layout.state_col, "source_code": layout.code_col, "area_name": layout.name_col,
        "provider_name": layout.provider_name_col, "provider_acronym": layout.provider_acronym_col,
        "provider_scope": layout.provider_scope_col, "response_status": layout.response_col,
    }
    facts = below.groupBy(*SHEET, "row").agg(*[
        (F.lit("") if col is None else F.coalesce(F.max(F.when(F.col("col") == col, F.col("value"))), F.lit(""))).alias(n)
        for n, col in wanted.items()
    ]).where(F.col("_state") == state)
    described = described.select(
        *SHEET, "col", "indicator", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "unit", "formula", "family")]
    )
    grid = facts.join(described, SHEET)
    valued = grid.join(cleaned(cells).select(*SHEET, "row", "col", F.col("value").alias("raw_value")), [*SHEET, "row", "col"], "left")
    level = "municipio_prestador" if layout.provider_name_col is not None else "municipio"
    raw = F.coalesce("raw_value", F.lit(""))
    return valued.select(
        *SHEET, tx.strip_decimal_tail("source_code").alias("source_code"), "area_name",
        F.lit(layout.year).alias("year"), F.lit(layout.component).alias("component"),
        "provider_name", "provider_acronym", "provider_scope", "family", "indicator", "name", "formula", "unit",
        raw.alias("raw_value"), val.decimal_comma(raw).alias("value"),
        "response_status", F.lit(layout.source).alias("source"), F.lit(level).alias("source_level"),
    ).withColumn("value_status", val.value_status("raw_value", "value"))


def survey_rows(cells: DataFrame) -> DataFrame:
    """Survey sheets: rows below the one header row, positional values, statuses.

    Year and month come from the file name (``..._YYYY_MM``).  Sheets without
    exactly one header row give no rows; ``survey_header_violations`` lists them.
    """
    first = cleaned(cells).where((F.col("col") == 0) & (F.col("value") == fv.SURVEY_HEADER_TOKEN))
    headers = first.groupBy(*SHEET).agg(F.min("row").alias("header_row"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1)
    below = cleaned(cells).join(headers, SHEET).where(F.col("row") > F.col("header_row"))

    def at(col: int):
        return F.coalesce(F.max(F.when(F.col("col") == col, F.col("value"))), F.lit(""))

    named = {"_first": 0, "area_name": 1, "state": 2, "period_text": 3}
    start = fv.SURVEY_FIRST_VALUE_POSITION
    wide = below.groupBy(*SHEET, "row").agg(
        *[at(c).alias(n) for n, c in named.items()],
        *[at(start + i).alias(n) for i, n in enumerate(fv.SURVEY_VALUE_COLUMNS)],
    )
    code = F.regexp_extract("_first", r"(\d{6})", 1)
    year_month = r"_(\d{4})_(\d{2})"
    # a cell that is not a plain number is missing, as for a strict number parser
    numbers = [val.number(n).alias(n) for n in fv.SURVEY_VALUE_COLUMNS]
    typed = wide.where(code != "").select(
        *SHEET, code.alias("source_code"), "area_name", "state",
        F.regexp_extract("file", year_month, 1).try_cast("int").alias("year"),
        F.regexp_extract("file", year_month, 2).try_cast("int").alias("month"), "period_text", *numbers,
    )
    return (
        typed.withColumn("status", val.survey_status("iip_aedes_aegypti", "period_text"))
        .withColumn("outlier", val.above("ib_aedes_aegypti"))
        .withColumn("reference_date", F.make_date("year", "month", F.lit(1)))
        .withColumn("source", F.lit(fv.SURVEY_SOURCE))
    )


def survey_header_violations(cells: DataFrame) -> DataFrame:
    from vigipanel.operators.quality import violations

    first = cleaned(cells).where(F.col("col") == 0).groupBy(*SHEET).agg(
        F.count_if(F.col("value") == fv.SURVEY_HEADER_TOKEN).alias("_n")
    )
    return violations(first.where(F.col("_n") != 1), "survey_header", F.concat_ws("|", *SHEET), F.concat(F.lit("headers="), F.col("_n")))
