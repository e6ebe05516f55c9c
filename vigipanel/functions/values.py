"""Value cells: numbers written as text, statuses and flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import as_col
from vigipanel.functions.text import clean_text


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text) -> Column:
    """Plain decimal number; a type suffix such as ``1d`` is text, not a number."""
    cell = as_col(text)
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double"))


def decimal_comma(value) -> Column:
    """Number from text with a decimal comma; what is no number gives null."""
    return number(F.replace(clean_text(value), F.lit(","), F.lit(".")))


def value_status(text, value) -> Column:
    """Observed, absent, or the literal text that stood in place of a number.

    ``value`` is the column parsed by ``decimal_comma`` one projection earlier,
    so that the text is parsed once.
    """
    cell = clean_text(text)
    return (
        F.when(as_col(value).isNotNull(), fv.OBSERVED)
        .when(cell == "", fv.ABSENT)
        .otherwise(cell)
    )


def numeric_status(value) -> Column:
    """Status for a source that only gives numbers."""
    return F.when(as_col(value).isNull(), fv.ABSENT).otherwise(fv.OBSERVED)


def survey_status(measure, period_text) -> Column:
    """Observed, excused by an official letter, or not reported."""
    excused = F.lower(clean_text(period_text)).rlike(fv.JUSTIFIED_PATTERN)
    return (
        F.when(as_col(measure).isNotNull(), fv.OBSERVED)
        .when(excused, fv.JUSTIFIED)
        .otherwise(fv.NOT_REPORTED)
    )


def above(value, limit: float = fv.SURVEY_OUTLIER_LIMIT) -> Column:
    """Outlier flag: strictly above the limit; null is not flagged."""
    return F.coalesce(as_col(value) > F.lit(limit), F.lit(False))


def standardised(value, mean, deviation) -> Column:
    return F.try_divide(as_col(value) - as_col(mean), as_col(deviation))


def largest_absolute(*values) -> Column:
    return F.greatest(*[F.abs(as_col(v)) for v in values])


def apportion(parts: list, units: int) -> Column:
    """Whole units per part by largest remainder; the array sums to ``units``.

    Negative parts count as zero; ties of the remainder go to the earlier part.
    A row whose parts sum to nothing gives null.
    """
    shares = F.array(*[F.greatest(as_col(p).cast("double"), F.lit(0.0)) for p in parts])
    total = F.aggregate(shares, F.lit(0.0), lambda acc, v: acc + v)
    exact = F.transform(shares, lambda v: F.try_divide(v, total) * F.lit(units))
    whole = F.transform(exact, lambda v: F.floor(v).cast("long"))
    left = F.lit(units) - F.aggregate(whole, F.lit(0).cast("long"), lambda acc, v: acc + v)
    order = F.array_sort(
        F.transform(exact, lambda v, i: F.struct((-(v - F.floor(v))).alias("r"), i.alias("i")))
    )
    winners = F.slice(F.transform(order, lambda e: e["i"]), F.lit(1), left.cast("int"))
    result = F.transform(
        whole, lambda v, i: v + F.when(F.array_contains(winners, i), 1).otherwise(0)
    )
    return F.when(total > 0, result)
