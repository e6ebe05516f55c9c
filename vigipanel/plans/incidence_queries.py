"""Records, incidence indicators, dense series, coverage and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import records as rec, values as val
from vigipanel.operators import series, summary
from vigipanel.plans.registry import query
from vigipanel.plans.views import FIRST_YEAR, LAST_YEAR, whole

ANNUAL_COLUMNS = """code, name, year, probable_cases, discarded_cases, classified_cases, unlabelled_cases,
 CAST(population AS BIGINT) AS population, round(incidence, 6) + 0.0 AS incidence, time_axis, area_criterion"""


@query("annual_incidence", f"SELECT {ANNUAL_COLUMNS} FROM annual")
def annual_incidence(v):
    return whole(v.annual)


@query("annual_incidence_sparse", """
WITH c AS (SELECT code, CAST(year(symptom_date) AS BIGINT) AS year, count(*) FILTER (WHERE probable) AS p,
  count(*) FILTER (WHERE discarded) AS d FROM record
  WHERE class_code = '12' AND delay_days BETWEEN 1 AND 59 AND year(symptom_date) BETWEEN 1995 AND 2000 GROUP BY 1, 2)
SELECT p.code, p.year, coalesce(c.p, 0) AS probable_cases, coalesce(c.d, 0) AS discarded_cases, CAST(p.population AS BIGINT) AS population,
  round(CAST(coalesce(c.p, 0) AS DOUBLE) / p.population * 1000, 6) + 0.0 AS incidence
FROM population p LEFT JOIN c ON c.code = p.code AND c.year = p.year""")
def annual_incidence_sparse(v):
    return whole(v.annual_sparse.select("code", "year", "probable_cases", "discarded_cases", "population", "incidence"))


@query("case_fact", """
SELECT code, base_year, 'municipio_residencia' AS criterion, residence_code, symptom_date, notification_date, delay_days,
  symptom_week, class_code, class_label, discarded, probable FROM record""")
def case_fact(v):
    return whole(v.records)


@query("delay_masked", """
SELECT code, base_year, count(*) AS records, count(CASE WHEN delay_days >= 0 THEN delay_days END) AS known_delays,
  CAST(sum(CASE WHEN delay_days >= 0 THEN delay_days END) AS BIGINT) AS delay_sum, min(delay_days) AS lowest_delay
FROM record GROUP BY 1, 2""")
def delay_masked(v):
    masked = rec.masked_delay_days("symptom_date", "notification_date")
    return whole(
        v.records.withColumn("masked", masked).groupBy("code", "base_year").agg(
            F.count(F.lit(1)).alias("records"), F.count("masked").alias("known_delays"),
            F.sum("masked").alias("delay_sum"), F.min("delay_days").alias("lowest_delay"),
        )
    )


@query("mixed_date_parse", """
SELECT o_orderkey AS order_key, CASE o_orderkey % 5 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed,
  (o_orderkey % 5 = 3) AS rejected FROM orders""")
def mixed_date_parse(v):
    """Order dates written in four ways and as junk, then parsed."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    text = (
        F.when(key % 5 == 0, F.date_format(day, "yyyyMMdd")).when(key % 5 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(key % 5 == 3, F.lit("sem data"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )
    parsed = v.table("orders").select(key.alias("order_key"), text.alias("text")).select(
        "order_key", rec.parse_mixed_date("text").alias("parsed")
    )
    return parsed.withColumn("rejected", F.col("parsed").isNull())


SERIES_COLUMNS = "code, name, {0}, probable_cases, discarded_cases, time_axis, area_criterion"


@query("monthly_series", f"SELECT {SERIES_COLUMNS.format('month')} FROM monthly")
def monthly_series(v):
    return whole(v.monthly)


@query("weekly_series", f"SELECT {SERIES_COLUMNS.format('week')} FROM weekly")
def weekly_series(v):
    return whole(v.weekly)


@query("record_coverage", """
SELECT base_year, count(*) AS records, count(DISTINCT code) AS areas, count(symptom_date) AS valid_symptom_dates,
  count(notification_date) AS valid_notification_dates, count(*) FILTER (WHERE probable) AS probable_cases,
  count(*) FILTER (WHERE discarded) AS discarded_cases,
  count(*) FILTER (WHERE class_label = 'codigo_original_nao_rotulado') AS unlabelled_records,
  count(*) FILTER (WHERE symptom_date < DATE '1995-01-01' OR symptom_date >= DATE '2001-01-01') AS symptoms_outside_period,
  CAST(median(delay_days) AS DOUBLE) AS median_delay_days
FROM record GROUP BY 1""")
def record_coverage(v):
    return whole(series.record_coverage(v.records, FIRST_YEAR, LAST_YEAR))


@query("annual_summary", """
SELECT year, count(*) AS areas, CAST(sum(probable_cases) AS BIGINT) AS probable_cases, CAST(sum(population) AS BIGINT) AS population,
  round(avg(incidence), 6) + 0.0 AS mean_incidence, round(min(incidence), 6) + 0.0 AS min_incidence, round(max(incidence), 6) + 0.0 AS max_incidence,
  count(*) FILTER (WHERE probable_cases = 0) AS areas_without_case,
  round(CAST(sum(probable_cases) AS DOUBLE) / CAST(sum(population) AS DOUBLE) * 1000, 6) + 0.0 AS pooled_incidence,
  round(quantile_cont(incidence, 0.25), 6) + 0.0 AS p25_incidence, round(median(incidence), 6) + 0.0 AS median_incidence,
  round(quantile_cont(incidence, 0.75), 6) + 0.0 AS p75_incidence
FROM annual GROUP BY 1""")
def annual_summary(v):
    return whole(summary.annual_summary(v.annual))


@query("ratio_of_sums", """
SELECT a.region_code, n.year, CAST(sum(n.probable_cases) AS BIGINT) AS cases, CAST(sum(n.population) AS BIGINT) AS population,
  round(CAST(sum(n.probable_cases) AS DOUBLE) / CAST(sum(n.population) AS DOUBLE) * 1000, 6) + 0.0 AS incidence
FROM annual n JOIN area a ON a.code = n.code GROUP BY 1, 2""")
def ratio_of_sums(v):
    return whole(summary.ratio_of_sums(v.annual.join(v.area.select("code", "region_code"), "code"), ["region_code", "year"]))


@query("annual_extremes", """
SELECT 'maior' AS extreme, year, position, code, name, round(incidence, 6) + 0.0 AS incidence FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY incidence DESC, code) AS position FROM annual) WHERE position <= 10
UNION ALL
SELECT 'menor', year, position, code, name, round(incidence, 6) + 0.0 FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY incidence, code) AS position FROM annual) WHERE position <= 10""")
def annual_extremes(v):
    return whole(summary.annual_extremes(v.annual).select("extreme", "year", "position", "code", "name", "incidence"))


@query("winsorised_map_values", """
SELECT code, year, round(incidence, 6) + 0.0 AS incidence, round((SELECT quantile_cont(incidence, 0.99) FROM annual), 6) + 0.0 AS limit_value,
  round(least(incidence, (SELECT quantile_cont(incidence, 0.99) FROM annual)), 6) + 0.0 AS map_value FROM annual""")
def winsorised_map_values(v):
    return whole(summary.winsorised(v.annual, "incidence").select("code", "year", "incidence", "limit_value", "map_value"))


LOOKUP_CODE = "3300077"


@query("point_lookup_annual", f"""
SELECT year, probable_cases, discarded_cases, classified_cases, unlabelled_cases, CAST(population AS BIGINT) AS population,
  round(incidence, 6) + 0.0 AS incidence, time_axis, area_criterion FROM annual WHERE code = '{LOOKUP_CODE}' AND year BETWEEN 1996 AND 1999""")
def point_lookup_annual(v):
    found = summary.within_years(summary.lookup(
        v.annual, LOOKUP_CODE,
        ["year", "probable_cases", "discarded_cases", "classified_cases", "unlabelled_cases", "population",
         "incidence", "time_axis", "area_criterion"], ["year"],
    ), 1996, 1999)
    return whole(found).orderBy("year")


@query("point_lookup_monthly", f"""
SELECT month, probable_cases, discarded_cases, time_axis, area_criterion FROM monthly
WHERE code = '{LOOKUP_CODE}' AND year(month) BETWEEN 1996 AND 1999""")
def point_lookup_monthly(v):
    found = summary.lookup(v.monthly, LOOKUP_CODE, ["month", "probable_cases", "discarded_cases", "time_axis", "area_criterion"], ["month"])
    return whole(summary.within_years(found, 1996, 1999, F.year("month")))


@query("point_lookup_indicators", f"""
SELECT year, system, component, indicator, standard_code, name, unit, value, raw_value, value_status, comparability, provider_code
FROM indicator_fact WHERE code = '{LOOKUP_CODE}'""")
def point_lookup_indicators(v):
    columns = ["year", "system", "component", "indicator", "standard_code", "name", "unit", "value", "raw_value",
               "value_status", "comparability", "provider_code"]
    return whole(summary.lookup(v.indicators, LOOKUP_CODE, columns, [F.desc("year"), "component", "indicator"]))


@query("area_list", "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name FROM customer")
def area_list(v):
    return summary.area_list(v.table("customer").select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name")))


@query("thin_series", """
WITH placed AS (SELECT code, week, probable_cases, row_number() OVER (PARTITION BY code ORDER BY week) - 1 AS pos,
  count(*) OVER (PARTITION BY code) AS n FROM weekly)
SELECT code, week, probable_cases FROM placed WHERE pos % greatest(1, CAST(ceil(n / 60.0) AS BIGINT)) = 0""")
def thin_series(v):
    return whole(summary.thinned(v.weekly.select("code", "week", "probable_cases"), ["code"], "week"))


@query("apportion_units", """
WITH s AS (SELECT code, year, CAST(probable_cases AS DOUBLE) AS a, CAST(discarded_cases AS DOUBLE) AS b,
    CAST(classified_cases AS DOUBLE) AS c FROM annual),
e AS (SELECT code, year, i, part / (a + b + c) * 500 AS exact FROM (
  SELECT *, 1 AS i, a AS part FROM s UNION ALL SELECT *, 2, b FROM s UNION ALL SELECT *, 3, c FROM s) WHERE a + b + c > 0),
r AS (SELECT code, year, i, CAST(floor(exact) AS BIGINT) AS f, row_number() OVER (PARTITION BY code, year ORDER BY floor(exact) - exact, i) AS o,
  500 - CAST(sum(floor(exact)) OVER (PARTITION BY code, year) AS BIGINT) AS rest FROM e)
SELECT code, year, CAST(sum(CASE WHEN i = 1 THEN f + CASE WHEN o <= rest THEN 1 ELSE 0 END END) AS BIGINT) AS units_probable,
  CAST(sum(CASE WHEN i = 2 THEN f + CASE WHEN o <= rest THEN 1 ELSE 0 END END) AS BIGINT) AS units_discarded,
  CAST(sum(CASE WHEN i = 3 THEN f + CASE WHEN o <= rest THEN 1 ELSE 0 END END) AS BIGINT) AS units_classified FROM r GROUP BY 1, 2""")
def apportion_units(v):
    units = v.annual.withColumn("u", val.apportion(["probable_cases", "discarded_cases", "classified_cases"], 500))
    return units.where(F.col("u").isNotNull()).select(
        "code", F.col("year").cast("long").alias("year"),
        *[F.get("u", F.lit(i)).alias(n) for i, n in enumerate(("units_probable", "units_discarded", "units_classified"))],
    )


@query("control_totals", "SELECT year, CAST(sum(population) AS BIGINT) AS total FROM population GROUP BY 1")
def control_totals(v):
    return whole(summary.totals_by(v.population, ["year"], "population", "total"))


@query("safe_projection", """
SELECT base_year, 'municipio_residencia' AS criterion, code, CAST(notification_date AS VARCHAR) AS "DT_NOTIFIC",
  CAST(symptom_date AS VARCHAR) AS "DT_SIN_PRI", symptom_week AS "SEM_PRI", residence_code AS "ID_MN_RESI", class_code AS "CLASSI_FIN" FROM record""")
def safe_projection(v):
    """National layout with identifiers, cut to residents and safe columns."""
    from vigipanel.sources.tables import residents_only

    national = v.staged.withColumn("_base", F.col("base_year")).select(
        F.concat(F.lit("r"), F.col("_base").cast("string")).alias("_file"),
        F.col("notification_date").cast("string").alias("DT_NOTIFIC"), F.lit("").alias("SEM_NOT"),
        F.col("symptom_date").cast("string").alias("DT_SIN_PRI"), F.col("symptom_week").alias("SEM_PRI"),
        F.col("residence_code").alias("ID_MN_RESI"), F.lit("").alias("CS_SEXO"), F.lit("").alias("NU_IDADE_N"),
        F.col("class_code").alias("CLASSI_FIN"), F.lit("").alias("CRITERIO"), F.lit("").alias("EVOLUCAO"),
        F.lit("").alias("DT_OBITO"), F.lit("").alias("DT_ENCERRA"), F.lit("").alias("SOROTIPO"),
        F.lit("nome").alias("NM_PACIENT"), F.lit("rua").alias("LOGRADOURO"),
    )
    kept = residents_only(national, v.area)
    assert not set(fv.FORBIDDEN_IDENTIFIERS) & set(kept.columns)
    return whole(kept.select("base_year", "criterion", "code", "DT_NOTIFIC", "DT_SIN_PRI", "SEM_PRI", "ID_MN_RESI", "CLASSI_FIN"))
