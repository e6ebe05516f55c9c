"""Notification records: flags, labels, dates, delays and epidemiological weeks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import as_col

DATE_FORMATS = ("yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy")


def discarded(class_code) -> Column:
    """True only for the discarded class; a missing class is not discarded."""
    return as_col(class_code).eqNullSafe(F.lit(fv.DISCARDED_CLASS))


def probable(class_code) -> Column:
    """Every record that is not discarded, also one without a class."""
    return ~discarded(class_code)


def class_label(class_code, labels: dict[str, str] = fv.CLASS_LABELS,
                default: str = fv.UNLABELLED_CLASS) -> Column:
    code = as_col(class_code)
    result = None
    for value, label in labels.items():
        result = F.when(code == value, label) if result is None else result.when(code == value, label)
    return result.otherwise(default)


def parse_mixed_date(text, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits; text that fits none gives null."""
    cell = F.trim(as_col(text))
    return F.coalesce(*[F.try_to_timestamp(cell, F.lit(f)) for f in formats]).cast("date")


def delay_days(symptom, notification) -> Column:
    """Days from first symptoms to notification; negative delays stay."""
    return F.datediff(as_col(notification), as_col(symptom))


def masked_delay_days(symptom, notification) -> Column:
    """As ``delay_days``, but a negative delay is unknown."""
    days = delay_days(symptom, notification)
    return F.when(days >= 0, days)


def month_of(date) -> Column:
    return F.trunc(as_col(date), "MM")


def iso_week_text(date) -> Column:
    """ISO year and week as ``YYYYWW``."""
    day = as_col(date)
    year = F.date_part(F.lit("YEAROFWEEK"), day).cast("int")
    return F.format_string("%04d%02d", year, F.weekofyear(day))


def week_year(week) -> Column:
    return F.left(as_col(week), F.lit(4)).try_cast("int")


def week_number(week) -> Column:
    return F.right(as_col(week), F.lit(2)).try_cast("int")


def valid_week(week, first_year: int, last_year: int) -> Column:
    return week_year(week).between(first_year, last_year) & week_number(week).between(1, 53)
