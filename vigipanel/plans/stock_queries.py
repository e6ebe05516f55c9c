"""Active stock, hold-out metrics, stored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel.operators import stock
from vigipanel.plans.registry import query
from vigipanel.plans.views import whole

GAMMA = 0.25


def _cases(v):
    return v.monthly.select("code", "month", "probable_cases")


@query("active_fixed_window", """
SELECT code, month, probable_cases, sum(CAST(probable_cases AS DOUBLE)) OVER (PARTITION BY code ORDER BY month ROWS 3 PRECEDING) AS active FROM monthly""")
def active_fixed_window(v):
    return whole(stock.fixed_window_active(_cases(v), ["code"], "month", "probable_cases", 4))


@query("trailing_sum", """
SELECT code, week, CAST(sum(probable_cases) OVER (PARTITION BY code ORDER BY week ROWS 7 PRECEDING) AS DOUBLE) AS eight_weeks FROM weekly""")
def trailing_sum(v):
    return whole(stock.fixed_window_active(v.weekly, ["code"], "week", "probable_cases", 8, "eight_weeks").select("code", "week", "eight_weeks"))


OUTFLOW = """
WITH RECURSIVE o AS (SELECT code, month, CAST(probable_cases AS DOUBLE) AS c, row_number() OVER (PARTITION BY code ORDER BY month) AS t FROM monthly),
f AS (SELECT code, month, t, c AS active FROM o WHERE t = 1
  UNION ALL SELECT o.code, o.month, o.t, f.active + o.c - 0.25::DOUBLE * f.active FROM f JOIN o ON o.code = f.code AND o.t = f.t + 1)
"""


@query("active_outflow", OUTFLOW + "SELECT code, month, round(active, 6) + 0.0 AS active_outflow FROM f")
def active_outflow(v):
    return whole(stock.outflow_active(_cases(v), ["code"], "month", "probable_cases", GAMMA).select("code", "month", "active_outflow"))


@query("estimator_comparison", """
WITH RECURSIVE o AS (SELECT code, month, CAST(probable_cases AS DOUBLE) AS reported, detection, CAST(probable_cases AS DOUBLE) / detection AS corrected,
    row_number() OVER (PARTITION BY code, detection ORDER BY month) AS t
  FROM monthly, (VALUES (1.0::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE)) d(detection)),
f AS (SELECT code, month, detection, t, corrected AS active FROM o WHERE t = 1
  UNION ALL SELECT o.code, o.month, o.detection, o.t, f.active + o.corrected - 0.25::DOUBLE * f.active
  FROM f JOIN o ON o.code = f.code AND o.detection = f.detection AND o.t = f.t + 1)
SELECT o.code, o.month, o.detection, o.reported, o.corrected, sum(o.corrected) OVER (PARTITION BY o.code, o.detection ORDER BY o.month ROWS 3 PRECEDING) AS active_window,
  round(f.active, 6) + 0.0 AS active_outflow FROM o JOIN f ON f.code = o.code AND f.detection = o.detection AND f.t = o.t""")
def estimator_comparison(v):
    return whole(stock.compare_estimators(_cases(v), ["code"], "month", "probable_cases", 4, (1.0, 0.5, 0.25)))


def _fitted(v):
    """A stand-in fit: the mean of the last three months against the month itself."""
    from pyspark.sql import Window

    order = Window.partitionBy("code").orderBy("month").rowsBetween(-3, -1)
    return _cases(v).withColumn("observed", F.col("probable_cases").cast("double")).withColumn(
        "modelled", F.coalesce(F.avg("probable_cases").over(order), F.lit(0.0))
    )


HOLDOUT = """
WITH p AS (SELECT code, month, CAST(probable_cases AS DOUBLE) AS observed, coalesce(avg(probable_cases) OVER (PARTITION BY code ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS modelled,
  row_number() OVER (PARTITION BY code ORDER BY month) AS r, count(*) OVER (PARTITION BY code) AS n FROM monthly),
m AS (SELECT code, r <= n - 12 AS train, modelled - observed AS res FROM p),
h AS (SELECT code, count(*) FILTER (WHERE train) AS train_size, count(*) FILTER (WHERE NOT train) AS validation_size, avg(abs(res)) AS mae, sqrt(avg(res * res)) AS rmse,
  avg(abs(res)) FILTER (WHERE train) AS train_mae, sqrt(avg(res * res) FILTER (WHERE train)) AS train_rmse,
  avg(abs(res)) FILTER (WHERE NOT train) AS validation_mae, sqrt(avg(res * res) FILTER (WHERE NOT train)) AS validation_rmse FROM m GROUP BY 1)
"""


@query("holdout_metrics", HOLDOUT + """
SELECT code, train_size, validation_size, round(mae, 6) + 0.0 AS mae, round(rmse, 6) + 0.0 AS rmse, round(train_mae, 6) + 0.0 AS train_mae, round(train_rmse, 6) + 0.0 AS train_rmse,
  round(validation_mae, 6) + 0.0 AS validation_mae, round(validation_rmse, 6) + 0.0 AS validation_rmse FROM h""")
def holdout_metrics(v):
    return whole(stock.holdout_metrics(_fitted(v), ["code"], "month", 12))


@query("calibration_assessment", HOLDOUT + """,
s AS (SELECT code, avg(probable_cases) AS scale FROM monthly GROUP BY 1),
x AS (SELECT h.code, (a.key % 6) / 5.0 AS beta, a.key % 4 <> 1 AS converged, CASE WHEN a.key % 7 = 2 THEN 0 ELSE validation_size END AS vs, validation_rmse / scale AS nrmse
  FROM h JOIN area a ON a.code = h.code JOIN s ON s.code = h.code),
r AS (SELECT *, concat_ws('|', CASE WHEN NOT converged THEN 'otimizacao_nao_convergiu' END,
  CASE WHEN vs = 0 OR nrmse IS NULL THEN 'validacao_temporal_ausente' WHEN nrmse > 0.3 THEN 'nrmse_validacao_acima_do_limite' END,
  CASE WHEN beta <= 0.05 OR beta >= 0.95 THEN 'beta_proximo_ao_limite_de_busca' END) AS reasons FROM x)
SELECT code, round(nrmse, 6) + 0.0 AS validation_nrmse, beta <= 0.05 OR beta >= 0.95 AS at_bound, reasons, reasons = '' AS accepted FROM r""")
def calibration_assessment(v):
    """Hold-out metrics judged; rates and convergence come from area keys."""
    scale = _cases(v).groupBy("code").agg(F.avg("probable_cases").alias("scale"))
    results = (
        stock.holdout_metrics(_fitted(v), ["code"], "month", 12).join(v.area.select("code", "key"), "code").join(scale, "code")
        .withColumn("beta", (F.col("key") % 6) / 5).withColumn("converged", F.col("key") % 4 != 1)
        .withColumn("validation_size", F.when(F.col("key") % 7 == 2, 0).otherwise(F.col("validation_size")))
    )
    judged = stock.assess_calibration(results, "scale", 0.3, 0.05, 0.0, 1.0)
    return whole(judged.select("code", "validation_nrmse", "at_bound", "reasons", "accepted"))


@query("scenario_compare", """
SELECT b.code, b.day, b.susceptible AS susceptible_base, b.infected AS infected_base, b.removed AS removed_base,
  first_value(b.susceptible) OVER (PARTITION BY b.code ORDER BY b.day) - b.susceptible AS cumulative_base,
  round(b.basic_reproduction * b.susceptible / b.population, 9) + 0.0 AS effective_base, i.infected AS infected_intervention,
  first_value(i.susceptible) OVER (PARTITION BY b.code ORDER BY b.day) - i.susceptible AS cumulative_intervention,
  round(i.basic_reproduction * i.susceptible / i.population, 9) + 0.0 AS effective_intervention
FROM run_rows b JOIN run_rows i ON i.code = b.code AND i.day = b.day AND i.execution_id = 'intervention' WHERE b.execution_id = 'base'""")
def scenario_compare(v):
    return whole(stock.scenario_comparison(v.runs("base"), v.runs("intervention")), 9)


@query("scenario_peaks", """
SELECT execution_id, code, max(infected) AS peak, min(day) FILTER (WHERE r = 1) AS peak_day FROM (
  SELECT *, row_number() OVER (PARTITION BY execution_id, code ORDER BY infected DESC, day) AS r FROM run_rows) GROUP BY 1, 2""")
def scenario_peaks(v):
    return whole(stock.run_peaks(v.runs("base").unionByName(v.runs("intervention"))))


@query("scenario_validity", """
WITH t AS (SELECT p_partkey, p_retailprice AS population, CAST(p_size AS DOUBLE) * 30 AS infected, CAST(p_partkey % 13 AS DOUBLE) * 20 - 20 AS removed,
  CASE WHEN p_partkey % 17 = 5 THEN NULL ELSE (p_partkey % 11) / 10.0 - 0.1 END AS beta, (p_partkey % 5) / 10.0 AS gamma FROM part),
u AS (SELECT *, coalesce(population > 0 AND infected >= 0 AND removed >= 0 AND infected + removed <= population AND beta >= 0 AND gamma > 0, false) AS valid FROM t)
SELECT p_partkey, valid, CASE WHEN valid THEN round(population - infected - removed, 6) + 0.0 END AS susceptible,
  CASE WHEN valid THEN round(beta / gamma, 6) + 0.0 END AS basic_reproduction FROM u""")
def scenario_validity(v):
    """Scenario parameters from part sizes, prices and keys; many are out of domain."""
    key = F.col("p_partkey")
    table = v.table("part").select(
        key, F.col("p_retailprice").alias("population"), (F.col("p_size") * 30.0).alias("infected"),
        ((key % 13) * 20.0 - 20).alias("removed"), F.when(key % 17 != 5, (key % 11) / 10 - 0.1).alias("beta"),
        ((key % 5) / 10).alias("gamma"),
    )
    return whole(stock.valid_parameters(table).select("p_partkey", "valid", "susceptible", "basic_reproduction"))
