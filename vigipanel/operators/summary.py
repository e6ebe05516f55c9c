"""Descriptive summaries: yearly statistics, extremes, coverage, lookups, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigipanel import fixed_values as fv
from vigipanel.operators.joins import same_groups
from vigipanel.operators.ranking import exact_quantiles, row_positions
from vigipanel.session import cut_lineage


def ratio_of_sums(df: DataFrame, keys: list[str], cases: str = "probable_cases",
                  population: str = "population", scale: float = fv.INCIDENCE_SCALE) -> DataFrame:
    """Incidence of the union of areas: sum over sum, never a mean of ratios."""
    return df.groupBy(*keys).agg(
        F.sum(cases).alias("cases"), F.sum(population).alias("population")
    ).withColumn("incidence", F.try_divide(F.col("cases").cast("double"), F.col("population")) * scale)


def annual_summary(annual: DataFrame) -> DataFrame:
    """One row per year: totals, ratio of sums and the spread over areas."""
    annual = cut_lineage(annual.select("year", "probable_cases", "population", "incidence"))
    v = F.col("incidence")
    base = annual.groupBy("year").agg(
        F.count(F.lit(1)).alias("areas"),
        F.sum("probable_cases").alias("probable_cases"),
        F.sum("population").alias("population"),
        F.avg(v).alias("mean_incidence"),
        F.min(v).alias("min_incidence"),
        F.max(v).alias("max_incidence"),
        F.count_if(F.col("probable_cases") == 0).alias("areas_without_case"),
    )
    spread = exact_quantiles(
        annual, ["year"], "incidence",
        {"p25_incidence": 0.25, "median_incidence": 0.5, "p75_incidence": 0.75},
    )
    pooled = F.try_divide(F.col("probable_cases").cast("double"), F.col("population"))
    return base.withColumn("pooled_incidence", pooled * fv.INCIDENCE_SCALE).join(spread, "year", "left")


def annual_extremes(annual: DataFrame, k: int = 10) -> DataFrame:
    """The k highest and the k lowest areas of each year, ties by code.

    ``row_number <= k`` lets Spark keep k rows per task before the shuffle.
    """
    annual = cut_lineage(annual)

    def side(order, label):
        window = Window.partitionBy("year").orderBy(order, F.col("code"))
        return (
            annual.withColumn("position", F.row_number().over(window))
            .where(F.col("position") <= k)
            .withColumn("extreme", F.lit(label))
        )

    return side(F.col("incidence").desc(), fv.EXTREME_HIGH).unionByName(
        side(F.col("incidence").asc(), fv.EXTREME_LOW)
    )


def winsorised(df: DataFrame, value: str, probability: float = 0.99) -> DataFrame:
    """Values cut at one upper quantile of the whole table."""
    df = cut_lineage(df)
    limit = exact_quantiles(df, [], value, {"_limit": probability}).scalar()
    return df.withColumn("limit_value", limit).withColumn(
        "map_value", F.least(F.col(value), F.col("limit_value"))
    )


def thinned(df: DataFrame, series: list[str], order: str, frames: int = 60) -> DataFrame:
    """Every n-th row of a series so that at most ``frames`` remain."""
    placed = row_positions(df, series, [order], "_position")
    placed = cut_lineage(placed)
    sizes = placed.groupBy(*series).agg(F.max("_position").alias("_size"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_size") / F.lit(frames)))
    return (
        same_groups(placed, sizes, series)
        .where((F.col("_position") - 1) % step == 0)
        .drop("_position", "_size")
    )


def duplicate_providers(indicators: DataFrame) -> DataFrame:
    """Area, year and standard code with several rows, and who reported them.

    Names are made distinct before they are listed, so one crowded key does not
    carry its rows into one task.
    """
    keys = ["system", "year", "standard_code", "code"]
    named = (
        indicators.where(F.col("standard_code").isNotNull())
        .groupBy(*keys, "provider_name").agg(F.count(F.lit(1)).alias("_rows"))
    )
    return (
        named.groupBy(*keys)
        .agg(
            F.sum("_rows").alias("providers"),
            F.array_join(F.array_sort(F.collect_set("provider_name")), " | ").alias("provider_names"),
        )
        .where(F.col("providers") > 1)
    )


def survey_coverage(survey: DataFrame) -> DataFrame:
    return survey.groupBy("year", "month").agg(
        F.count_distinct("code").alias("areas"),
        F.count("iip").alias("areas_with_iip"),
        F.count_if(F.col("status") == fv.JUSTIFIED).alias("areas_justified"),
        F.count_if(F.col("status") != fv.OBSERVED).alias("areas_without_result"),
    )


def panel_coverage(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year", "month").agg(
        F.count_distinct("code").alias("areas"),
        F.count("iip").alias("areas_with_iip"),
        F.count("ib").alias("areas_with_ib"),
        F.sum(F.col("outlier").cast("int")).alias("flagged_outliers"),
    )


def indicator_coverage(indicators: DataFrame) -> DataFrame:
    """Areas, areas with a value, codes and rows per system, year and component.

    Rows are first counted per (area, code), so that the distinct counts unfold
    few rows instead of the whole fact.
    """
    keys = ["system", "year", "component"]
    cells = indicators.groupBy(*keys, "code", "indicator").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("value").alias("_values"), F.min("source_level").alias("_level")
    )
    return cells.groupBy(*keys).agg(
        F.count_distinct("code").alias("areas_in_base"),
        F.count_distinct(F.when(F.col("_values") > 0, F.col("code"))).alias("areas_with_value"),
        F.count_distinct("indicator").alias("indicators"),
        F.sum("_rows").alias("rows"), F.sum("_values").alias("values_present"),
        F.min("_level").alias("source_level"),
    )


def pivoted(df: DataFrame, keys: list[str], name: str, value: str, columns: dict[str, str]) -> DataFrame:
    """Long to wide with a fixed column list.

    A pivot must not hide duplicates: check the key with ``quality.unique_key``
    first, as percentages of several providers are never averaged.
    """
    wide = df.groupBy(*keys).pivot(name, list(columns)).agg(F.max(value))
    return wide.select(*keys, *[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide to long; null cells stay."""
    return df.unpivot(keys, columns, name, value)


def totals_by(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(alias))


def area_list(areas: DataFrame) -> DataFrame:
    return areas.select("code", "name").orderBy("name")


def lookup(df: DataFrame, code: str, columns: list[str], order: list) -> DataFrame:
    """Rows of one area; the code is a value, never part of a query text."""
    return df.where(F.col("code") == F.lit(code)).select(*columns).orderBy(*order)


def within_years(df: DataFrame, first_year: int, last_year: int, year=None) -> DataFrame:
    return df.where((F.col("year") if year is None else year).between(first_year, last_year))


def file_statistics(files: DataFrame, limit: int = fv.OVERSIZE_LIMIT) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("total_bytes"),
        F.max("length").alias("largest_bytes"),
        F.count_if(F.col("length") > limit).alias("files_over_limit"),
    )
