"""Panel, correlations, leave-one-out influence, line fits and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import values as val
from vigipanel.operators import association as assoc, regression as reg, summary
from vigipanel.plans.comparison_models import BP_P, T_P, model_sql, t_tail
from vigipanel.plans.registry import query
from vigipanel.plans.views import whole

GROUP = "indicator, lag, outlier_rule"
RULES = {"iip": (fv.OUTLIER_NOT_APPLICABLE,), "ib": (fv.OUTLIER_INCLUDED, fv.OUTLIER_EXCLUDED)}
MODEL_RULES = {"iip": fv.OUTLIER_NOT_APPLICABLE, "ib": fv.OUTLIER_EXCLUDED}
BALANCED_RULES = {"ib": fv.OUTLIER_INCLUDED}


@query("survey_panel", """
SELECT code, name, year, month, reference_date, iip, ib, status, outlier, CAST(population AS BIGINT) AS population, cases_0, cases_1, cases_2, cases_3,
  round(incidence_0, 6) + 0.0 AS incidence_0, round(incidence_1, 6) + 0.0 AS incidence_1, round(incidence_2, 6) + 0.0 AS incidence_2,
  round(incidence_3, 6) + 0.0 AS incidence_3, area_criterion, time_axis FROM panel""")
def survey_panel(v):
    return whole(v.panel)


RANKED = """
ranked AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY x) + (count(*) OVER (PARTITION BY {g}, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2.0 AS ry FROM pairs)
"""


def _cross_section(v):
    """Yearly incidence against the two service indicators of the area."""
    wide = summary.pivoted(v.area_indicators, ["code", "year"], "indicator", "value", {"IN055": "IN055", "IN056": "IN056"})
    joined = v.annual.select("code", "name", "year", "incidence").join(wide, ["code", "year"], "left")
    return joined.unpivot(["code", "name", "year", "incidence"], ["IN055", "IN056"], "indicator", "x").select(
        "year", "indicator", F.col("code").alias("id"), "name", "x", F.col("incidence").alias("y")
    )


CROSS = """
WITH pairs AS (SELECT n.year, i.indicator, n.code AS id, n.name, i.value AS x, n.incidence AS y FROM annual n
  JOIN area_indicator i ON i.code = n.code AND i.year = n.year WHERE i.indicator IN ('IN055', 'IN056') AND i.value IS NOT NULL)
"""


@query("pearson_spearman", CROSS + "," + RANKED.format(g="year, indicator") + """
SELECT year, indicator, count(*) AS observations, round(corr(x, y), 6) + 0.0 AS pearson_r, round(corr(rx, ry), 6) + 0.0 AS spearman_rho FROM ranked GROUP BY 1, 2""")
def pearson_spearman(v):
    return whole(assoc.correlations(_cross_section(v), ["year", "indicator"]).drop("pearson_p", "spearman_p"))


LAGGED = "WITH pairs AS (SELECT * FROM panel_pairs)," + RANKED.format(g="indicator, lag, outlier_rule")


@query("lag_associations", LAGGED + """
SELECT indicator, lag, outlier_rule, count(*) AS observations, round(corr(x, y), 6) + 0.0 AS pearson_r, round(corr(rx, ry), 6) + 0.0 AS spearman_rho,
  'associacao_temporal_exploratoria_nao_causal' AS note FROM ranked GROUP BY 1, 2, 3""")
def lag_associations(v):
    return whole(assoc.lag_associations(v.panel, RULES).drop("pearson_p", "spearman_p"))


@query("association_pvalues", LAGGED + f"""
, c AS (SELECT indicator, lag, outlier_rule, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS s FROM ranked GROUP BY 1, 2, 3)
SELECT indicator, lag, outlier_rule, n AS observations, round({t_tail('r', '(n - 3)')}, 6) + 0.0 AS pearson_p, round({t_tail('s', '(n - 3)')}, 6) + 0.0 AS spearman_p FROM c""")
def association_pvalues(v):
    return whole(assoc.lag_associations(v.panel, RULES).select(
        "indicator", "lag", "outlier_rule", "observations", "pearson_p", "spearman_p"
    ))


@query("leave_one_out", f"""
WITH pairs AS (SELECT {GROUP}, code || '|' || reference_date AS id, x, y FROM panel_pairs),
removed AS (SELECT r.indicator, r.lag, r.outlier_rule, r.id AS gone, p.id, p.x, p.y FROM pairs r JOIN pairs p ON p.indicator = r.indicator AND p.lag = r.lag AND p.outlier_rule = r.outlier_rule AND p.id <> r.id),
ranked AS (SELECT *, rank() OVER (PARTITION BY {GROUP}, gone ORDER BY x) + (count(*) OVER (PARTITION BY {GROUP}, gone, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {GROUP}, gone ORDER BY y) + (count(*) OVER (PARTITION BY {GROUP}, gone, y) - 1) / 2.0 AS ry FROM removed),
without_one AS (SELECT {GROUP}, gone AS id, corr(x, y) AS p, corr(rx, ry) AS s FROM ranked GROUP BY ALL),
full_rank AS (SELECT *, rank() OVER (PARTITION BY {GROUP} ORDER BY x) + (count(*) OVER (PARTITION BY {GROUP}, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {GROUP} ORDER BY y) + (count(*) OVER (PARTITION BY {GROUP}, y) - 1) / 2.0 AS ry FROM pairs),
base AS (SELECT {GROUP}, corr(x, y) AS bp, corr(rx, ry) AS bs FROM full_rank GROUP BY ALL)
SELECT {GROUP}, id, round(bp, 6) + 0.0 AS pearson_base, round(p, 6) + 0.0 AS pearson_without, round(bs, 6) + 0.0 AS spearman_base, round(s, 6) + 0.0 AS spearman_without,
  round(p - bp, 6) + 0.0 AS delta_pearson, round(s - bs, 6) + 0.0 AS delta_spearman, round(greatest(abs(p - bp), abs(s - bs)), 6) + 0.0 AS largest_influence
FROM without_one JOIN base USING ({GROUP})""")
def leave_one_out(v):
    """Every sample of the panel: both indicators, all lags, all outlier rules."""
    pairs = assoc.lagged_pairs(v.panel, RULES).withColumn("id", F.concat_ws("|", "code", "reference_date"))
    return whole(assoc.leave_one_out(pairs, ["indicator", "lag", "outlier_rule"], ["id"]))


@query("leave_one_out_yearly", CROSS + """,
removed AS (SELECT r.year, r.indicator, r.id AS gone, p.id, p.x, p.y FROM pairs r JOIN pairs p ON p.year = r.year AND p.indicator = r.indicator AND p.id <> r.id),
ranked AS (SELECT *, rank() OVER (PARTITION BY year, indicator, gone ORDER BY x) + (count(*) OVER (PARTITION BY year, indicator, gone, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY year, indicator, gone ORDER BY y) + (count(*) OVER (PARTITION BY year, indicator, gone, y) - 1) / 2.0 AS ry FROM removed)
SELECT year, indicator, gone AS id, round(corr(x, y), 6) + 0.0 AS pearson_without, round(corr(rx, ry), 6) + 0.0 AS spearman_without FROM ranked GROUP BY 1, 2, 3""")
def leave_one_out_yearly(v):
    """The yearly cross-section of incidence against service coverage, without each area in turn."""
    return whole(assoc.leave_one_out(_cross_section(v), ["year", "indicator"], ["id"]).select("year", "indicator", "id", "pearson_without", "spearman_without"))


@query("linear_fit_residuals", CROSS + """,
f AS (SELECT year, indicator, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pairs GROUP BY 1, 2),
r AS (SELECT p.*, slope, intercept, y - (intercept + slope * x) AS residual FROM pairs p JOIN f ON f.year = p.year AND f.indicator = p.indicator)
SELECT year, indicator, id, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(residual, 6) + 0.0 AS residual, position FROM (
  SELECT *, row_number() OVER (PARTITION BY year, indicator ORDER BY abs(residual) DESC, id) AS position FROM r) WHERE position <= 5""")
def linear_fit_residuals(v):
    return whole(assoc.largest_residuals(_cross_section(v), ["year", "indicator"]).select(
        "year", "indicator", "id", "slope", "intercept", "residual", "position"
    ))


@query("spec_standardise", """
WITH s AS (SELECT indicator, lag, code, reference_date, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, ln(1 + y) AS y
  FROM panel_pairs WHERE outlier_rule IN ('nao_aplicavel', 'exclui_ib_maior_100') WINDOW w AS (PARTITION BY indicator, lag))
SELECT indicator, lag, code, reference_date, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS log_outcome FROM s""")
def spec_standardise(v):
    samples = reg.standardised_samples(v.panel, MODEL_RULES)
    return whole(samples.select("indicator", "lag", "code", "reference_date", "x", F.log1p("y").alias("log_outcome")))


def _closed_form(sweep: str, k: str, lags: str) -> str:
    """Models of a balanced sample: means of both categories swept out in one pass."""
    return f"""
WITH s AS (SELECT lag, code, year, month, reference_date, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, y FROM panel_pairs
  WHERE indicator = 'ib' AND outlier_rule = 'inclui_sinalizados' AND lag IN ({lags}) WINDOW w AS (PARTITION BY lag)),
o AS (SELECT lag, 'original' AS transform, code, year, month, reference_date, x, y FROM s
  UNION ALL SELECT lag, 'log1p', code, year, month, reference_date, x, ln(1 + y) FROM s),
d AS (SELECT *, {sweep} FROM o),
b AS (SELECT lag, transform, count(*) AS n, count(DISTINCT code) AS g, {k} AS k, sum(dx * dx) AS xx, sum(dx * dy) / sum(dx * dx) AS beta,
  var_pop(y) * count(*) AS tss FROM d GROUP BY 1, 2),
e AS (SELECT d.lag, d.transform, d.code, d.dx, d.dy - b.beta * d.dx AS e FROM d JOIN b ON b.lag = d.lag AND b.transform = d.transform),
m AS (SELECT lag, transform, sum(s * s) AS meat, sum(q) AS rss FROM (
  SELECT lag, transform, code, sum(dx * e) AS s, sum(e * e) AS q FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT lag, transform, n AS observations, g AS clusters, round(beta, 6) + 0.0 AS coefficient, round(se, 6) + 0.0 AS cluster_error,
  round(r2, 6) + 0.0 AS r_squared, round({t_tail("(beta / sqrt((g - 1) * se * se + beta * beta))", "(g - 2)")}, 6) + 0.0 AS p_value
FROM (SELECT b.*, sqrt(CAST(b.g AS DOUBLE) / (b.g - 1) * (b.n - 1) / (b.n - b.k) * m.meat) / b.xx AS se, 1 - m.rss / b.tss AS r2
  FROM b JOIN m ON m.lag = b.lag AND m.transform = b.transform)"""


_GRAND = "{v} - avg({v}) OVER (PARTITION BY lag, transform) AS d{v}"
_TWO = ("{v} - avg({v}) OVER (PARTITION BY lag, transform, {a}) - avg({v}) OVER (PARTITION BY lag, transform, {b})"
        " + avg({v}) OVER (PARTITION BY lag, transform) AS d{v}")


def _models(v, adjustment: str, lags: int):
    samples = reg.standardised_samples(v.panel, BALANCED_RULES, lags)
    rows = reg.specifications(samples, adjustments=(adjustment,)).drop("outlier_rule")
    return whole(reg.clustered_models(rows).select(
        "lag", "transform", "observations", "clusters", "coefficient", "cluster_error", "r_squared", "p_value"
    ))


@query("ols_plain", _closed_form(", ".join(_GRAND.format(v=c) for c in "xy"), "2", "0, 1, 2, 3"))
def ols_plain(v):
    return _models(v, "bruto", 3)


MODEL = f"""lag, transform, n AS observations, g AS clusters, round(beta, 6) + 0.0 AS coefficient, round(se, 6) + 0.0 AS cluster_error,
  round(r2, 6) + 0.0 AS r_squared, {T_P} AS p_value"""


# the last rounds lack the outcome three months on, so the sample of lag 3 is unbalanced
@query("ols_time", model_sql(MODEL, "indicator = 'ib' AND outlier_rule = 'inclui_sinalizados'", fv.TRANSFORMS, ("tempo",)))
def ols_time(v):
    return _models(v, "tempo", 3)


@query("ols_two_way", _closed_form(
    ", ".join(_TWO.format(v=c, a="code", b="reference_date") for c in "xy"),
    "2 + count(DISTINCT code) - 1 + count(DISTINCT reference_date) - 1", "0, 1, 2, 3"))
def ols_two_way(v):
    return _models(v, "municipio_rodada", 3)


PUBLISHED = "outlier_rule IN ('nao_aplicavel', 'exclui_ib_maior_100')"


@query("model_grid", model_sql(f"""indicator, lag, transform, adjustment, n AS observations, g AS clusters, round(beta, 6) + 0.0 AS coefficient, round(se, 6) + 0.0 AS cluster_error,
  round(beta / se, 6) + 0.0 AS t_statistic, {T_P} AS p_value, round(r2, 6) + 0.0 AS r_squared, round(bp, 6) + 0.0 AS bp_statistic, {BP_P} AS bp_p,
  CASE indicator WHEN 'iip' THEN '{fv.OUTLIER_NOT_APPLICABLE}' ELSE '{fv.OUTLIER_EXCLUDED}' END AS outlier_rule, '{fv.COEFFICIENT_NOTE}' AS note""", PUBLISHED, fv.TRANSFORMS, fv.ADJUSTMENTS))
def model_grid(v):
    """All 48 published models."""
    return whole(reg.model_grid(v.panel, MODEL_RULES))


@query("breusch_pagan", model_sql(f"indicator, lag, transform, adjustment, n AS observations, round(bp, 6) + 0.0 AS bp_statistic, {BP_P} AS bp_p", PUBLISHED, fv.TRANSFORMS, ("bruto", "tempo")))
def breusch_pagan(v):
    """Both indicators, all lags, both transforms, plain and with time dummies."""
    samples = reg.standardised_samples(v.panel, MODEL_RULES)
    rows = reg.specifications(samples, adjustments=("bruto", "tempo")).drop("outlier_rule")
    return whole(reg.clustered_models(rows).select("indicator", "lag", "transform", "adjustment", "observations", "bp_statistic", "bp_p"))


@query("largest_absolute", """
SELECT code, reference_date, round(greatest(abs(iip - 5), abs(ib - 25)), 6) + 0.0 AS largest FROM survey WHERE iip IS NOT NULL""")
def largest_absolute(v):
    rows = v.survey.where(F.col("iip").isNotNull())
    return whole(rows.select(
        "code", "reference_date", val.largest_absolute(F.col("iip") - 5, F.col("ib") - 25).alias("largest")
    ))
