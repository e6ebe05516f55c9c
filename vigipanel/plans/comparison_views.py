"""The same views as SQL, for the second engine."""

from __future__ import annotations

import re

from vigipanel.plans.comparison_bijection import bijection_walk, dealt_by

VIEWS = {
    "area": """
SELECT '33' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || CAST(n_nationkey % 10 AS VARCHAR) AS code,
       n_name AS name, CAST(r_regionkey AS VARCHAR) AS region_code, r_name AS region,
       CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y, n_nationkey AS key
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "years": "SELECT CAST(unnest(generate_series(1995, 2000)) AS BIGINT) AS year",
    "population": """
SELECT a.code, y.year, 1000 * p.n + 10 * (y.year - 1995) AS population
FROM (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1) p JOIN area a ON a.key = p.key, years y""",
    "record": """
SELECT *, CAST(notification_date - symptom_date AS BIGINT) AS delay_days,
       lpad(CAST(isoyear(symptom_date) AS VARCHAR), 4, '0') || lpad(CAST(week(symptom_date) AS VARCHAR), 2, '0') AS symptom_week,
       CASE class_code WHEN '5' THEN 'descartado' WHEN '10' THEN 'dengue' WHEN '11' THEN 'dengue_com_sinais_de_alarme'
            WHEN '12' THEN 'dengue_grave' ELSE 'codigo_original_nao_rotulado' END AS class_label,
       coalesce(class_code = '5', false) AS discarded, coalesce(class_code <> '5', true) AS probable
FROM (
  SELECT a.code, left(a.code, 6) AS residence_code, CAST(year(l_shipdate) AS BIGINT) AS base_year,
         CAST(o_orderdate AS DATE) AS symptom_date, CAST(l_shipdate AS DATE) AS notification_date,
         CASE WHEN l_returnflag = 'R' THEN '5' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '10'
              WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity > 45 THEN '12' ELSE '11' END
              WHEN l_linestatus = 'F' THEN '8' END AS class_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN area a ON a.key = c_nationkey)""",
    "annual_counts": """
SELECT code, CAST(year(symptom_date) AS BIGINT) AS year,
       count(*) FILTER (WHERE probable) AS probable_cases, count(*) FILTER (WHERE discarded) AS discarded_cases,
       count(*) FILTER (WHERE class_label IN ('dengue', 'dengue_com_sinais_de_alarme', 'dengue_grave')) AS classified_cases,
       count(*) FILTER (WHERE probable AND class_label = 'codigo_original_nao_rotulado') AS unlabelled_cases
FROM record WHERE year(symptom_date) BETWEEN 1995 AND 2000 GROUP BY 1, 2""",
    "annual": """
SELECT p.code, a.name, p.year, coalesce(probable_cases, 0) AS probable_cases, coalesce(discarded_cases, 0) AS discarded_cases,
       coalesce(classified_cases, 0) AS classified_cases, coalesce(unlabelled_cases, 0) AS unlabelled_cases, p.population,
       CAST(coalesce(probable_cases, 0) AS DOUBLE) / p.population * 1000 AS incidence,
       'DT_SIN_PRI' AS time_axis, 'ID_MN_RESI' AS area_criterion
FROM population p JOIN area a ON a.code = p.code LEFT JOIN annual_counts c ON c.code = p.code AND c.year = p.year""",
    "months": "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS month",
    "monthly": """
SELECT a.code, a.name, m.month, coalesce(c.p, 0) AS probable_cases, coalesce(c.d, 0) AS discarded_cases,
       'DT_SIN_PRI' AS time_axis, 'ID_MN_RESI' AS area_criterion
FROM area a CROSS JOIN months m LEFT JOIN (
  SELECT code, CAST(date_trunc('month', symptom_date) AS DATE) AS month, count(*) FILTER (WHERE probable) AS p,
         count(*) FILTER (WHERE discarded) AS d
  FROM record WHERE symptom_date >= DATE '1995-01-01' AND symptom_date < DATE '2001-01-01' GROUP BY 1, 2
) c ON c.code = a.code AND c.month = m.month""",
    "week_records": """
SELECT * FROM record WHERE try_cast(left(symptom_week, 4) AS INTEGER) BETWEEN 1995 AND 2000
   AND try_cast(right(symptom_week, 2) AS INTEGER) BETWEEN 1 AND 53""",
    "weekly": """
SELECT a.code, a.name, w.week, coalesce(c.p, 0) AS probable_cases, coalesce(c.d, 0) AS discarded_cases,
       'SEM_PRI' AS time_axis, 'ID_MN_RESI' AS area_criterion
FROM area a CROSS JOIN (SELECT DISTINCT symptom_week AS week FROM week_records) w LEFT JOIN (
  SELECT code, symptom_week AS week, count(*) FILTER (WHERE probable) AS p, count(*) FILTER (WHERE discarded) AS d
  FROM week_records GROUP BY 1, 2) c ON c.code = a.code AND c.week = w.week""",
    "provider_year": """
SELECT a.code, s.s_suppkey AS provider_code, s.s_name AS provider_name, g.*
FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS n,
             count(*) FILTER (WHERE l_returnflag = 'A') AS n_a,
             CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
             CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
             count(*) FILTER (WHERE l_linestatus = 'F') AS n_f
      FROM lineitem GROUP BY 1, 2) g
JOIN supplier s ON s.s_suppkey = g.l_suppkey JOIN area a ON a.key = s.s_nationkey""",
    "provider_units": """
SELECT code, year, provider_code, provider_name, n, 'IN055' AS legacy, 'IAG0001' AS current, (n_a * 2000000 + n) // (2 * n) AS units FROM provider_year
UNION ALL SELECT code, year, provider_code, provider_name, n, 'IN049', 'IAG2013', (tax * 20000 + n) // (2 * n) FROM provider_year
UNION ALL SELECT code, year, provider_code, provider_name, n, 'IN015', 'IES2002', (qty * 20000 + n) // (2 * n) FROM provider_year
UNION ALL SELECT code, year, provider_code, provider_name, n, 'IN046', 'IES2003', (disc * 20000 + n) // (2 * n) FROM provider_year
UNION ALL SELECT code, year, provider_code, provider_name, n, 'IN056', 'IES0001', (n_f * 2000000 + n) // (2 * n) FROM provider_year""",
    "provider_text": """
SELECT code, year, provider_code, provider_name, legacy, current,
       CASE WHEN n % 11 = 0 THEN 'Não Calc.- Div/0' WHEN n % 13 = 0 THEN ''
            ELSE CAST(units // 10000 AS VARCHAR) || ',' || lpad(CAST(units % 10000 AS VARCHAR), 4, '0') END AS raw_value
FROM provider_units""",
    "decision": """
SELECT * FROM (VALUES ('abastecimento_agua', 'IN055', 'IAG0001', 'comparavel_direto'),
 ('abastecimento_agua', 'IN049', 'IAG2013', 'nao_comparavel_formula_alterada'),
 ('esgotamento_sanitario', 'IN015', 'IES2002', 'similar_com_ruptura_definicao'),
 ('esgotamento_sanitario', 'IN016', 'IES2004', 'similar_com_ruptura_definicao'),
 ('esgotamento_sanitario', 'IN046', 'IES2003', 'comparavel_apenas_base_municipal'),
 ('esgotamento_sanitario', 'IN056', 'IES0001', 'comparavel_direto')) t(component, legacy_code, current_code, comparability)""",
    "indicator_fact": """
SELECT t.code, t.year, t.provider_code, t.provider_name,
       CASE WHEN t.year >= 2000 THEN t.current ELSE t.legacy END AS indicator,
       CASE WHEN t.year >= 2000 THEN 'SINISA' ELSE 'SNIS' END AS system,
       CASE WHEN t.legacy IN ('IN049', 'IN055') THEN 'abastecimento_agua' ELSE 'esgotamento_sanitario' END AS component,
       'Indicador ' || CASE WHEN t.year >= 2000 THEN t.current ELSE t.legacy END
         || CASE WHEN t.year BETWEEN 1998 AND 1999 THEN ' (revisado)' ELSE '' END AS name,
       'percentual' AS unit, CASE WHEN t.year >= 2000 THEN 'Atendimento' END AS family, '' AS formula, t.raw_value,
       try_cast(replace(t.raw_value, ',', '.') AS DOUBLE) AS value,
       CASE WHEN t.raw_value = '' THEN 'ausente' WHEN try_cast(replace(t.raw_value, ',', '.') AS DOUBLE) IS NULL THEN t.raw_value
            ELSE 'observado' END AS value_status,
       'municipio_prestador' AS source_level,
       CASE WHEN d.comparability = 'comparavel_direto' THEN d.current_code END AS standard_code,
       coalesce(d.comparability, 'nao_avaliado') AS comparability
FROM provider_text t LEFT JOIN decision d
  ON (CASE WHEN t.year >= 2000 THEN t.current ELSE t.legacy END) IN (d.legacy_code, d.current_code)""",
    "area_indicator": """
SELECT code, year, indicator, value FROM (
  SELECT *, row_number() OVER (PARTITION BY code, year, indicator ORDER BY provider_code) AS r FROM indicator_fact) WHERE r = 1""",
    "survey_cells": """
SELECT a.code, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month, count(*) AS n,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN area a ON a.key = s_nationkey
WHERE year(l_shipdate) <= 2000 AND month(l_shipdate) IN (1, 4, 7, 10) GROUP BY 1, 2, 3""",
    "survey_values": """
SELECT code, year, month, make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), 1) AS reference_date,
       CASE WHEN n % 9 <> 0 THEN round(CAST(disc AS DOUBLE) / n, 6) END AS iip, round(CAST(qty AS DOUBLE) / n, 6) AS ib,
       CASE WHEN n % 2 = 0 THEN 'Ofício com justificativa' ELSE '' END AS period_text
FROM survey_cells""",
    "survey": """
SELECT code, year, month, reference_date, iip, ib,
       CASE WHEN iip IS NOT NULL THEN 'observado'
            WHEN regexp_matches(lower(period_text), 'justific|of.cio|oficio') THEN 'justificativa' ELSE 'nao_informado' END AS status,
       ib > 26 AS outlier
FROM survey_values""",
    "panel": """
SELECT s.code, a.name, s.year, s.month, s.reference_date, s.iip, s.ib, s.status, s.outlier, p.population,
       s0.probable_cases AS cases_0, s1.probable_cases AS cases_1, s2.probable_cases AS cases_2, s3.probable_cases AS cases_3,
       CAST(s0.probable_cases AS DOUBLE) / p.population * 1000 AS incidence_0, CAST(s1.probable_cases AS DOUBLE) / p.population * 1000 AS incidence_1,
       CAST(s2.probable_cases AS DOUBLE) / p.population * 1000 AS incidence_2, CAST(s3.probable_cases AS DOUBLE) / p.population * 1000 AS incidence_3,
       'ID_MN_RESI' AS area_criterion, 'DT_SIN_PRI' AS time_axis
FROM survey s JOIN area a ON a.code = s.code JOIN population p ON p.code = s.code AND p.year = s.year
LEFT JOIN monthly s0 ON s0.code = s.code AND s0.month = s.reference_date
LEFT JOIN monthly s1 ON s1.code = s.code AND s1.month = s.reference_date + INTERVAL 1 MONTH
LEFT JOIN monthly s2 ON s2.code = s.code AND s2.month = s.reference_date + INTERVAL 2 MONTH
LEFT JOIN monthly s3 ON s3.code = s.code AND s3.month = s.reference_date + INTERVAL 3 MONTH""",
    "panel_pairs": """
SELECT indicator, lag, outlier_rule, code, year, month, reference_date, x, y, outlier FROM (
  SELECT i.indicator, CAST(l.lag AS BIGINT) AS lag, i.outlier_rule, p.code, p.year, p.month, p.reference_date, p.outlier,
         CASE i.indicator WHEN 'iip' THEN iip ELSE ib END AS x,
         CASE l.lag WHEN 0 THEN incidence_0 WHEN 1 THEN incidence_1 WHEN 2 THEN incidence_2 ELSE incidence_3 END AS y
  FROM panel p, (VALUES ('iip', 'nao_aplicavel'), ('ib', 'inclui_sinalizados'), ('ib', 'exclui_ib_maior_100')) i(indicator, outlier_rule),
       (VALUES (0), (1), (2), (3)) l(lag))
WHERE x IS NOT NULL AND y IS NOT NULL AND outlier IS NOT NULL AND NOT (outlier_rule = 'exclui_ib_maior_100' AND outlier)""",
    "queen_edge": """
SELECT 'contiguidade_rainha' AS rule, a.code AS src, b.code AS dst,
       CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) = 1 THEN 'rook' ELSE 'queen_point' END AS contact,
       count(*) OVER (PARTITION BY a.code) AS neighbours, 1.0 / count(*) OVER (PARTITION BY a.code) AS weight
FROM area a JOIN area b ON greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1""",
    "mesh": """
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey // 100 AS DOUBLE) AS y FROM customer""",
    "mesh_edge": """
SELECT a.code AS src, b.code AS dst, CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) = 1 THEN 'rook' ELSE 'queen_point' END AS contact,
       count(*) OVER (PARTITION BY a.code) AS neighbours, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY a.code) AS weight
FROM mesh a JOIN mesh b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.code <> b.code""",
    "rook_edge": """
SELECT 'contiguidade_torre' AS rule, src, dst, contact, count(*) OVER (PARTITION BY src) AS neighbours,
       CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY src) AS weight
FROM queen_edge WHERE contact = 'rook'""",
    "knn4_edge": """
SELECT 'k_vizinhos_4' AS rule, src, dst, 'centroide_mais_proximo' AS contact, CAST(4 AS BIGINT) AS neighbours, CAST(0.25 AS DOUBLE) AS weight, sqrt(d2) AS distance
FROM (SELECT a.code AS src, b.code AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
             row_number() OVER (PARTITION BY a.code ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.code) AS r
      FROM area a JOIN area b ON a.code <> b.code) WHERE r <= 4""",
    "all_edges": """
SELECT rule, src, dst, CAST(weight AS DOUBLE) AS weight FROM queen_edge
UNION ALL SELECT rule, src, dst, weight FROM rook_edge UNION ALL SELECT rule, src, dst, weight FROM knn4_edge""",
    "centred": """
SELECT year, code, name, incidence AS value, incidence - avg(incidence) OVER (PARTITION BY year) AS z,
       count(*) OVER (PARTITION BY year) AS n, row_number() OVER (PARTITION BY year ORDER BY code) AS position FROM annual""",
    "squares": "SELECT year, sum(z * z) AS zz FROM centred GROUP BY 1",
    "lagged": """
SELECT e.rule, c.year, c.code, c.value, c.z, c.n, s.zz, sum(e.weight * d.z) AS lag
FROM centred c JOIN squares s ON s.year = c.year JOIN all_edges e ON e.src = c.code JOIN centred d ON d.code = e.dst AND d.year = c.year
GROUP BY ALL""",
    "observed_global": """
SELECT rule, year, count(*) AS areas, max(n) * sum(z * lag) / (count(*) * max(zz)) AS moran_i FROM lagged GROUP BY 1, 2""",
    "deal_global_walk": bijection_walk("SELECT year, perm, code, z, n, position - 1 AS p, 20240729 AS seed FROM centred, (SELECT unnest(generate_series(1, 999)) AS perm)", "deal_global_walk"),
    "deal_global": dealt_by("deal_global_walk"),
    "deal_yearly_walk": bijection_walk("SELECT year, perm, code, z, n, position - 1 AS p, 20240729 + year AS seed FROM centred, (SELECT unnest(generate_series(1, 999)) AS perm)", "deal_yearly_walk"),
    "deal_yearly": dealt_by("deal_yearly_walk"),
    "cumulative": """
SELECT m.*, CAST(datediff('month', DATE '1995-01-01', m.month) AS BIGINT) AS day, CAST(p.population AS DOUBLE) AS population,
       1.0 + (a.key % 5) / 10.0 AS basic_reproduction,
       CAST(sum(probable_cases) OVER w AS DOUBLE) AS sum_base, CAST(sum(discarded_cases) OVER w AS DOUBLE) AS sum_alt
FROM monthly m JOIN area a ON a.code = m.code JOIN population p ON p.code = m.code AND p.year = 1995
WINDOW w AS (PARTITION BY m.code ORDER BY m.month ROWS UNBOUNDED PRECEDING)""",
    "run_rows": """
SELECT 'base' AS execution_id, code, name, day, population - sum_base AS susceptible, CAST(probable_cases AS DOUBLE) AS infected,
       sum_base - probable_cases AS removed, population, basic_reproduction FROM cumulative
UNION ALL SELECT 'intervention', code, name, day, population - sum_alt, CAST(discarded_cases AS DOUBLE), sum_alt - discarded_cases,
       population, basic_reproduction FROM cumulative""",
}


def _needed(text: str, found: list[str]) -> None:
    for name in VIEWS:          # a recursive view needs itself, which is no other view
        if name not in found and VIEWS[name] is not text and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*[(=<>])", text, re.I):
            _needed(VIEWS[name], found)
            found.append(name)


def with_views(sql: str) -> str:
    """Put the views a statement needs in front of it."""
    found: list[str] = []
    _needed(sql, found)
    if not found:
        return sql.strip()
    ordered = [n for n in VIEWS if n in found]
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    body = sql.strip()
    # RECURSIVE allows recursive views and changes nothing for others
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"WITH RECURSIVE {views},\n{body[len(start):]}"
    return f"WITH RECURSIVE {views}\n{body}"
