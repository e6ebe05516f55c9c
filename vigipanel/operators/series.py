"""Counts, dense calendars and lagged panels over notification records.

Expected columns: records ``code, symptom_date, symptom_week, probable,
discarded, class_label``; areas ``code, name``; population ``code, year,
population``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import indicators as ind, records as rec
from vigipanel.session import cut_lineage

CONFIRMED_LABELS = tuple(l for c, l in fv.CLASS_LABELS.items() if c != fv.DISCARDED_CLASS)


def typed_records(raw: DataFrame, first_text_dates: bool = False) -> DataFrame:
    """The typed fact from staged records: flags, labels, dates and delay.

    Staged columns: ``code, residence_code, base_year, symptom_date,
    notification_date, symptom_week, class_code``; dates as text when
    ``first_text_dates``.
    """
    parse = rec.parse_mixed_date if first_text_dates else (lambda c: F.col(c).cast("date"))
    return (
        raw.withColumn("symptom_date", parse("symptom_date"))
        .withColumn("notification_date", parse("notification_date"))
        .select(
            "code", F.col("base_year").cast("int").alias("base_year"),
            F.lit(fv.RECORD_CRITERION).alias("criterion"), "residence_code",
            "symptom_date", "notification_date",
            rec.delay_days("symptom_date", "notification_date").alias("delay_days"),
            "symptom_week", "class_code",
            rec.class_label("class_code").alias("class_label"),
            rec.discarded("class_code").alias("discarded"),
            rec.probable("class_code").alias("probable"),
        )
    )


def in_period(records: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """A date range rather than ``year(d) BETWEEN``, so that scans can prune."""
    day = F.col("symptom_date")
    return records.where(
        (day >= F.lit(date(first_year, 1, 1))) & (day < F.lit(date(last_year + 1, 1, 1)))
    )


def _how_many(records: DataFrame, condition) -> Column:
    """Records that meet a condition; a row of ``day_counts`` stands for many."""
    if "records" not in records.columns:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col("records"))), F.lit(0).cast("long"))


def _class_counts(records: DataFrame):
    return [
        _how_many(records, F.col("probable")).alias("probable_cases"),
        _how_many(records, F.col("discarded")).alias("discarded_cases"),
    ]


DAY_KEYS = ["code", "symptom_date", "symptom_week", "class_label", "probable", "discarded"]


def day_counts(records: DataFrame) -> DataFrame:
    """Records by area, day, week text and class: what the annual, monthly and weekly series need of them.

    Counts of parts of the records add up to those of all: counts of counts are
    allowed, and each series takes them in place of the records.
    """
    many = F.sum("records") if "records" in records.columns else F.count(F.lit(1))
    return records.groupBy(*DAY_KEYS).agg(many.alias("records"))


def _zero_filled(*names: str):
    return [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names]


def annual_incidence(records: DataFrame, areas: DataFrame, population: DataFrame,
                     first_year: int, last_year: int) -> DataFrame:
    """One row per area and year of the population table; no case is zero."""
    label = F.col("class_label")
    counts = (
        in_period(records, first_year, last_year)
        .groupBy("code", F.year("symptom_date").alias("year"))
        .agg(
            *_class_counts(records),
            _how_many(records, label.isin(*CONFIRMED_LABELS)).alias("classified_cases"),
            _how_many(records, F.col("probable") & (label == fv.UNLABELLED_CLASS)).alias("unlabelled_cases"),
        )
    )
    cells = population.where(F.col("year").between(first_year, last_year)).join(
        areas.select("code", "name"), "code"
    )
    return (
        cells.join(counts, ["code", "year"], "left")
        .select(
            "code", "name", "year",
            *_zero_filled("probable_cases", "discarded_cases", "classified_cases", "unlabelled_cases"),
            "population",
        )
        .withColumn("incidence", ind.incidence("probable_cases", "population"))
        .withColumn("time_axis", F.lit(fv.SYMPTOM_AXIS))
        .withColumn("area_criterion", F.lit(fv.AGGREGATE_CRITERION))
    )


def month_grid(areas: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every area with every month: each area row unfolds its own calendar."""
    months = F.sequence(
        F.lit(date(first_year, 1, 1)), F.lit(date(last_year, 12, 1)), F.expr("interval 1 month")
    )
    return areas.select("code", "name", F.explode(months).alias("month"))


def monthly_series(records: DataFrame, areas: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Dense area by month counts on the symptom date, zeros explicit."""
    counts = (
        in_period(records, first_year, last_year)
        .groupBy("code", rec.month_of("symptom_date").alias("month"))
        .agg(*_class_counts(records))
    )
    return (
        month_grid(areas, first_year, last_year)
        .join(counts, ["code", "month"], "left")
        .select(
            "code", "name", "month", *_zero_filled("probable_cases", "discarded_cases"),
            F.lit(fv.SYMPTOM_AXIS).alias("time_axis"),
            F.lit(fv.AGGREGATE_CRITERION).alias("area_criterion"),
        )
    )


def weekly_series(records: DataFrame, areas: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Dense area by observed week counts on the reported week text.

    The calendar is the set of week texts that occur.  Areas unfold all weeks of
    the period and keep, by an equality join on (year, week), those that occur.
    """
    valid = records.where(rec.valid_week("symptom_week", first_year, last_year))
    # both the calendar and the grid need the counts: records are read once
    counts = cut_lineage(valid.groupBy("code", F.col("symptom_week").alias("week")).agg(*_class_counts(records)))
    observed = (
        counts.select("week").distinct()
        .withColumn("_year", rec.week_year("week"))
        .withColumn("_number", rec.week_number("week"))
    )
    years = F.sequence(F.lit(first_year), F.lit(last_year))
    grid = (
        areas.select("code", "name", F.explode(years).alias("_year"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(53))).alias("_number"))
        .join(observed, ["_year", "_number"])
    )
    return (
        grid.join(counts, ["code", "week"], "left")
        .select(
            "code", "name", "week", *_zero_filled("probable_cases", "discarded_cases"),
            F.lit(fv.WEEK_AXIS).alias("time_axis"),
            F.lit(fv.AGGREGATE_CRITERION).alias("area_criterion"),
        )
    )


def record_coverage(records: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Completeness of the records per base year.

    The median runs over whole days: its buffer holds one count per distinct
    delay, so it stays small however many records a year has.
    """
    day = F.col("symptom_date")
    outside = (day < F.lit(date(first_year, 1, 1))) | (day >= F.lit(date(last_year + 1, 1, 1)))
    return records.groupBy("base_year").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("code").alias("areas"),
        F.count("symptom_date").alias("valid_symptom_dates"),
        F.count("notification_date").alias("valid_notification_dates"),
        *_class_counts(records),
        F.count_if(F.col("class_label") == fv.UNLABELLED_CLASS).alias("unlabelled_records"),
        F.count_if(outside).alias("symptoms_outside_period"),
        F.median("delay_days").alias("median_delay_days"),
    )


def lagged_outcomes(monthly: DataFrame, lags: int = 3) -> DataFrame:
    """Per area and base month the cases 0..``lags`` months later; off the grid null.

    Each month row serves the base months it lies ahead of, so all lags come
    from one aggregation instead of one join per lag.
    """
    offsets = F.sequence(F.lit(0), F.lit(lags))
    ahead = monthly.select("code", "month", "probable_cases", F.explode(offsets).alias("_lag")).select(
        "code", F.expr("add_months(month, -_lag)").alias("base_month"), "_lag", "probable_cases"
    )
    return ahead.groupBy("code", "base_month").agg(
        *[F.max(F.when(F.col("_lag") == k, F.col("probable_cases"))).alias(f"cases_{k}")
          for k in range(lags + 1)]
    )


def survey_panel(survey: DataFrame, areas: DataFrame, population: DataFrame,
                 monthly: DataFrame, lags: int = 3) -> DataFrame:
    """Survey rounds with contemporary and later monthly incidence.

    Survey columns: ``code, year, month, reference_date, status`` and measures;
    a lag outside the monthly grid stays null, a month without a case is zero.
    """
    measures = [c for c in survey.columns if c not in ("code", "year", "month", "reference_date")]
    joined = (
        survey.join(areas.select("code", "name"), "code")
        .join(population.select("code", "year", "population"), ["code", "year"])
        .join(
            lagged_outcomes(monthly, lags).withColumnRenamed("base_month", "reference_date"),
            ["code", "reference_date"], "left",
        )
    )
    return joined.select(
        "code", "name", "year", "month", "reference_date", *measures, "population",
        *[F.col(f"cases_{k}") for k in range(lags + 1)],
        *[ind.incidence(f"cases_{k}", "population").alias(f"incidence_{k}") for k in range(lags + 1)],
        F.lit(fv.AGGREGATE_CRITERION).alias("area_criterion"),
        F.lit(fv.SYMPTOM_AXIS).alias("time_axis"),
    )
