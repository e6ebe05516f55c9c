"""Indicators, codes, components, quadrants and tail probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import as_col


def incidence(cases, population, scale: float = fv.INCIDENCE_SCALE) -> Column:
    """Cases per ``scale`` inhabitants; a population of zero gives null."""
    return F.try_divide(as_col(cases).cast("double"), as_col(population)) * F.lit(scale)


def incidence_domain(cases, population) -> Column:
    """Row predicate of the incidence: no negative cases, a positive population."""
    return (as_col(cases) >= 0) & (as_col(population) > 0)


def valid_area_code(code, prefix: str = "33", digits: int = 7) -> Column:
    rest = digits - len(prefix)
    return F.trim(as_col(code).cast("string")).rlike(rf"^{prefix}\d{{{rest}}}$")


def fact_component(code) -> Column:
    """Component rule of the fact: the water codes are listed, all else is sewer."""
    return F.when(as_col(code).isin(*fv.FACT_WATER_CODES), fv.WATER).otherwise(fv.SEWER)


def inventory_component(code) -> Column:
    """Component rule of the inventory: the sewer codes are listed, all else is water."""
    return F.when(as_col(code).isin(*fv.INVENTORY_SEWER_CODES), fv.SEWER).otherwise(fv.WATER)


def quadrant(centred, lag) -> Column:
    z, w = as_col(centred), as_col(lag)
    return (
        F.when((z > 0) & (w > 0), fv.QUADRANT_HIGH_HIGH)
        .when((z < 0) & (w < 0), fv.QUADRANT_LOW_LOW)
        .when((z > 0) & (w < 0), fv.QUADRANT_HIGH_LOW)
        .when((z < 0) & (w > 0), fv.QUADRANT_LOW_HIGH)
        .otherwise(fv.QUADRANT_UNDEFINED)
    )


def significant(label, p_value, level: float = fv.LOCAL_SIGNIFICANCE) -> Column:
    return F.when(as_col(p_value) < level, as_col(label)).otherwise(fv.NOT_SIGNIFICANT)


def _special(cls: str, method: str, *args: Column) -> Column:
    """A static method of the maths library that Spark itself ships."""
    return F.java_method(
        F.lit(f"org.apache.commons.math3.special.{cls}"), F.lit(method), *args
    ).cast("double")


def t_two_sided_p(statistic, degrees) -> Column:
    """Two-sided tail of Student's t."""
    t, df = as_col(statistic), as_col(degrees).cast("double")
    usable = t.isNotNull() & ~F.isnan(t) & (df > 0)
    ratio = df / (df + t * t)
    p = _special("Beta", "regularizedBeta", ratio, df / F.lit(2.0), F.lit(0.5))
    return F.when(usable, p)


def correlation_p(r, n) -> Column:
    """Two-sided p of a correlation of ``n`` pairs by the t distribution."""
    coef, df = as_col(r), as_col(n).cast("double") - 2
    usable = coef.isNotNull() & ~F.isnan(coef) & (df > 0)
    ratio = F.greatest(F.lit(1.0) - coef * coef, F.lit(0.0))
    p = _special("Beta", "regularizedBeta", ratio, df / F.lit(2.0), F.lit(0.5))
    return F.when(usable, p)


def chi2_upper_p(statistic, degrees) -> Column:
    """Upper tail of chi-square."""
    x, df = as_col(statistic), as_col(degrees).cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (x >= 0) & (df > 0)
    p = _special("Gamma", "regularizedGammaQ", df / F.lit(2.0), x / F.lit(2.0))
    return F.when(usable, p)
