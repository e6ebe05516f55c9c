"""Codes, names, statuses, indicator reshaping and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel.functions import indicators as ind, text as tx, values as val
from vigipanel.operators import catalogue, reconcile, summary
from vigipanel.plans.registry import query
from vigipanel.plans.views import MEASURES, whole
from vigipanel.sources import tables as src

CUSTOMER_CODE = "CASE WHEN c_custkey % 10 = 3 THEN '99' ELSE '33' END || lpad(CAST(c_nationkey AS VARCHAR), 4, '0')"


def _customer_codes(v):
    """Residence codes of customers; every tenth lives outside the areas."""
    prefix = F.when(F.col("c_custkey") % 10 == 3, "99").otherwise("33")
    return v.table("customer").select(
        "c_custkey", "c_nationkey", F.concat(prefix, F.lpad(F.col("c_nationkey").cast("string"), 4, "0")).alias("residence")
    )


@query("code_reconcile", f"""
SELECT c_custkey, residence, a.code FROM (SELECT *, {CUSTOMER_CODE} AS residence FROM customer) c
JOIN area a ON left(a.code, 6) = c.residence""")
def code_reconcile(v):
    return whole(reconcile.reconcile_codes(_customer_codes(v), "residence", v.area).select("c_custkey", "residence", "code"))


@query("code_passthrough", """
WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN a.code || '.0' WHEN 1 THEN left(a.code, 6) ELSE '990000' END AS raw
  FROM customer JOIN area a ON a.key = c_nationkey),
t AS (SELECT c_custkey, raw, regexp_replace(trim(raw), '\\.0$', '') AS source_code FROM s)
SELECT c_custkey, source_code, CASE WHEN length(source_code) = 7 THEN source_code ELSE a.code END AS code
FROM t LEFT JOIN area a ON left(a.code, 6) = left(t.source_code, 6)""")
def code_passthrough(v):
    own = v.table("customer").join(v.area.select("key", "code"), F.col("c_nationkey") == F.col("key"))
    key = F.col("c_custkey")
    raw = F.when(key % 3 == 0, F.concat("code", F.lit(".0"))).when(key % 3 == 1, F.left("code", F.lit(6))).otherwise("990000")
    return whole(
        reconcile.passthrough_codes(own.select("c_custkey", raw.alias("raw")), "raw", v.area)
        .select("c_custkey", "source_code", "code")
    )


@query("unknown_codes", f"""
SELECT residence, count(*) AS rows FROM (SELECT {CUSTOMER_CODE} AS residence FROM customer) c
WHERE residence NOT IN (SELECT left(code, 6) FROM area) GROUP BY 1""")
def unknown_codes(v):
    used = _customer_codes(v).groupBy("residence").agg(F.count(F.lit(1)).alias("rows"))
    known = reconcile.short_codes(v.area).select(F.col("code6").alias("residence"))
    return whole(used.join(known, "residence", "left_anti"))


@query("member_records", """
SELECT region_code, count(*) AS records FROM record r JOIN area a ON a.code = r.code WHERE region_code IN ('1', '3') GROUP BY 1""")
def member_records(v):
    chosen = v.area.where(F.col("region_code").isin("1", "3"))
    kept = reconcile.members_of(v.records, "code", chosen, "code")
    counted = kept.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return whole(counted.join(v.area.select("code", "region_code"), "code").groupBy("region_code").agg(F.sum("n").alias("records")))


@query("normalise_names", r"""
SELECT doc_id, upper(trim(regexp_replace(replace(strip_accents(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS normalised,
  strip_accents(text) <> text AS had_accents FROM documents""")
def normalise_names(v):
    return v.table("documents").select(
        "doc_id", tx.normalise_name("text").alias("normalised"), (tx.unaccent("text") != F.col("text")).alias("had_accents")
    )


@query("flatten_space", r"""
SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS flat FROM pages""")
def flatten_space(v):
    return v.table("pages").select("page_id", tx.flatten_space("html").alias("flat"))


@query("region_dimension", """
SELECT p.code, a.name, upper(a.name) AS normalised_name, 'RJ' AS state, '33' AS state_code, a.region_code, a.region
FROM (SELECT CASE WHEN c_custkey % 8 = 5 THEN '35' ELSE '33' END || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS code, c_nationkey FROM customer) p
JOIN area a ON a.key = p.c_nationkey WHERE starts_with(p.code, '33')""")
def region_dimension(v):
    """Customers as places named after their nation, found in the region list by name."""
    regions = v.area.select(F.lower("name").alias("area_name"), "region_code", "region")
    prefix = F.when(F.col("c_custkey") % 8 == 5, "35").otherwise("33")
    places = v.table("customer").join(v.area.select("key", "name"), F.col("c_nationkey") == F.col("key")).select(
        F.concat(prefix, F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("code"), F.concat(F.lit(" "), "name").alias("name")
    )
    return reconcile.area_dimension(places, regions)


@query("code_validity", """
SELECT s_suppkey, code, regexp_matches(trim(code), '^33[0-9]{5}$') AS valid FROM (
  SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN a.code WHEN 1 THEN left(a.code, 6) WHEN 2 THEN '35' || right(a.code, 5) ELSE ' ' || a.code END AS code
  FROM supplier JOIN area a ON a.key = s_nationkey)""")
def code_validity(v):
    own = v.table("supplier").join(v.area.select("key", "code"), F.col("s_nationkey") == F.col("key"))
    key = F.col("s_suppkey")
    code = (
        F.when(key % 4 == 0, F.col("code")).when(key % 4 == 1, F.left("code", F.lit(6)))
        .when(key % 4 == 2, F.concat(F.lit("35"), F.right("code", F.lit(5)))).otherwise(F.concat(F.lit(" "), "code"))
    )
    return own.select("s_suppkey", code.alias("code")).withColumn("valid", ind.valid_area_code("code"))


@query("value_status", """
SELECT code, year, provider_code, indicator, raw_value, value, value_status FROM indicator_fact""")
def value_status(v):
    return whole(v.indicators.select("code", "year", "provider_code", "indicator", "raw_value", "value", "value_status"))


@query("survey_status", "SELECT code, year, month, reference_date, iip, ib, status FROM survey")
def survey_status(v):
    return whole(v.survey.select("code", "year", "month", "reference_date", "iip", "ib", "status"))


@query("outlier_flag", "SELECT code, year, month, ib, outlier, iip > 5.0 IS TRUE AS iip_high FROM survey")
def outlier_flag(v):
    return whole(v.survey.select("code", "year", "month", "ib", "outlier", val.above("iip", 5.0).alias("iip_high")))


def _crosswalk(v):
    """Part names and types as a crosswalk table with codes inside expressions."""
    key = F.col("p_partkey")
    first = F.concat(F.lit("GTA"), F.lpad((key % 10000).cast("string"), 4, "0"))
    second = F.concat(F.lit("GTE"), F.lpad((key % 700).cast("string"), 4, "0"))
    expression = (
        F.when(key % 6 == 0, first).when(key % 6 == 1, F.concat(first, F.lit(" + "), second))
        .when(key % 6 == 2, F.lit("Não identificado")).when(key % 6 == 3, F.concat(F.lit("ver "), "p_name"))
        .when(key % 6 == 4, F.concat(first, F.lit("  e\n"), second, F.lit(" e "), first))
        .otherwise(F.concat(first, F.lit(" - 5")))
    )
    return v.table("part").select(
        F.col("p_brand").alias("group"),
        F.when(key % 50 == 49, "").otherwise(F.concat(F.lit("AG"), key.cast("string"))).alias("legacy_code"),
        F.col("p_type").alias("reference"), F.col("p_name").alias("description"), expression.alias("expression"),
        F.lit(None).cast("string").alias("current_description"),
        F.when(key % 7 == 0, " nota ").otherwise(F.lit(None)).alias("comments"),
    )


CROSSWALK = r"""
WITH raw AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 50 = 49 THEN '' ELSE 'AG' || p_partkey END AS legacy_code,
    'GTA' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS f, 'GTE' || lpad(CAST(p_partkey % 700 AS VARCHAR), 4, '0') AS s FROM part),
x AS (SELECT legacy_code, p_partkey, CASE p_partkey % 6 WHEN 0 THEN f WHEN 1 THEN f || ' + ' || s WHEN 2 THEN 'Não identificado' WHEN 3 THEN 'ver ' || p_name
    WHEN 4 THEN f || ' e ' || s || ' e ' || f ELSE f || ' - 5' END AS expression FROM raw WHERE legacy_code <> ''),
c AS (SELECT *, regexp_extract_all(expression, '\b[A-Z]{3}[0-9]{4}\b') AS codes FROM x)
"""


@query("code_extract", CROSSWALK + """
SELECT legacy_code, expression, CASE WHEN len(codes) = 3 THEN codes[1] || '|' || codes[2]
  ELSE array_to_string(codes, '|') END AS current_codes FROM c""")
def code_extract(v):
    return reconcile.information_crosswalk(_crosswalk(v)).select("legacy_code", "expression", "current_codes")


@query("correspondence_class", CROSSWALK + """
SELECT legacy_code, CASE WHEN lower(expression) = 'não identificado' THEN 'sem_correspondencia_identificada'
  WHEN len(codes) > 1 OR contains(expression, '+') OR contains(expression, ' - ') THEN 'composicao_ou_ajuste'
  WHEN len(codes) = 1 THEN 'correspondencia_direta' ELSE 'revisao_manual' END AS correspondence, p_partkey % 7 = 0 AS has_comment FROM c""")
def correspondence_class(v):
    return reconcile.information_crosswalk(_crosswalk(v)).select("legacy_code", "correspondence", "has_comment")


@query("melt_indicators", "SELECT code, year, provider_code, legacy AS indicator, raw_value FROM provider_text")
def melt_indicators(v):
    long = summary.unpivoted(
        v.indicators_wide, ["code", "year", "provider_code"], [m[0] for m in MEASURES], "indicator", "raw_value"
    )
    return whole(long)


@query("pivot_indicators", """
SELECT n.code, n.year, round(n.incidence, 6) + 0.0 AS incidence,
  max(CASE WHEN i.indicator = 'IN055' THEN i.value END) AS water_access, max(CASE WHEN i.indicator = 'IN056' THEN i.value END) AS sewer_access
FROM annual n LEFT JOIN area_indicator i ON i.code = n.code AND i.year = n.year GROUP BY 1, 2, 3""")
def pivot_indicators(v):
    wide = summary.pivoted(
        v.area_indicators, ["code", "year"], "indicator", "value", {"IN055": "water_access", "IN056": "sewer_access"}
    )
    return whole(v.annual.select("code", "year", "incidence").join(wide, ["code", "year"], "left"))


@query("duplicate_providers", """
SELECT system, year, standard_code, code, count(*) AS providers, string_agg(DISTINCT provider_name, ' | ' ORDER BY provider_name) AS provider_names
FROM indicator_fact WHERE standard_code IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def duplicate_providers(v):
    return whole(summary.duplicate_providers(v.indicators))


@query("distinct_variants", "SELECT DISTINCT system, component, indicator, name, unit FROM indicator_fact")
def distinct_variants(v):
    return v.indicators.select("system", "component", "indicator", "name", "unit").distinct()


@query("metadata_versions", """
SELECT system, component, indicator, name, unit, family, formula, min(year) AS first_year, max(year) AS last_year
FROM indicator_fact GROUP BY ALL""")
def metadata_versions(v):
    return whole(catalogue.metadata_variants(v.indicators))


@query("indicator_inventory", """
WITH m AS (SELECT system, component, indicator, name, unit, coalesce(family, '') AS family, formula, min(year) AS first_year, max(year) AS last_year
  FROM indicator_fact GROUP BY ALL),
n AS (SELECT *, 'v' || lpad(CAST(row_number() OVER (PARTITION BY system, component, indicator
  ORDER BY first_year, name, unit, family, formula, last_year) AS VARCHAR), 2, '0') AS version FROM m)
SELECT n.system || ':' || n.component || ':' || n.indicator || ':' || n.version AS id, n.system, n.component, n.indicator, n.name, n.unit, n.family,
  n.formula, n.first_year, n.last_year, n.version, coalesce(d.current_code, '') AS standard_code,
  coalesce(d.comparability, 'de_para_informacoes_disponivel_indicadores_pendentes') AS harmonisation
FROM n LEFT JOIN decision d ON n.system = 'SNIS' AND d.component = n.component AND d.legacy_code = n.indicator""")
def indicator_inventory(v):
    variants = catalogue.metadata_variants(v.indicators)
    return whole(catalogue.inventory(variants, reconcile.comparability(v.spark)))


@query("harmonised_indicators", """
SELECT code, year, provider_code, indicator, system, component, standard_code, comparability, value FROM indicator_fact""")
def harmonised_indicators(v):
    return whole(v.indicators.select(
        "code", "year", "provider_code", "indicator", "system", "component", "standard_code", "comparability", "value"
    ))


@query("comparability_use", """
SELECT d.component, d.legacy_code, d.current_code, d.comparability, count(f.indicator) AS rows FROM decision d
LEFT JOIN indicator_fact f ON f.indicator IN (d.legacy_code, d.current_code) GROUP BY ALL""")
def comparability_use(v):
    """Decision table and how many reported rows each decision touches."""
    used = v.indicators.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))
    both = reconcile.comparability(v.spark).withColumn("indicator", F.explode(F.array("legacy_code", "current_code")))
    return whole(
        both.join(used, "indicator", "left").groupBy("component", "legacy_code", "current_code", "comparability")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("rows"))
    )


@query("indicator_coverage", """
SELECT system, year, component, count(DISTINCT code) AS areas_in_base, count(DISTINCT CASE WHEN value IS NOT NULL THEN code END) AS areas_with_value,
  count(DISTINCT indicator) AS indicators, count(*) AS rows, count(value) AS values_present, 'municipio_prestador' AS source_level
FROM indicator_fact GROUP BY 1, 2, 3""")
def indicator_coverage(v):
    return whole(summary.indicator_coverage(v.indicators))


@query("survey_coverage", """
SELECT year, month, count(DISTINCT code) AS areas, count(iip) AS areas_with_iip, count(*) FILTER (WHERE status = 'justificativa') AS areas_justified,
  count(*) FILTER (WHERE status <> 'observado') AS areas_without_result FROM survey GROUP BY 1, 2""")
def survey_coverage(v):
    return whole(summary.survey_coverage(v.survey))


@query("panel_coverage", """
SELECT year, month, count(DISTINCT code) AS areas, count(iip) AS areas_with_iip, count(ib) AS areas_with_ib,
  CAST(sum(CAST(outlier AS INTEGER)) AS BIGINT) AS flagged_outliers FROM panel GROUP BY 1, 2""")
def panel_coverage(v):
    return whole(summary.panel_coverage(v.panel))


@query("source_class", """
SELECT page_id, CASE WHEN contains(p, 'sinan') OR contains(p, 'dengue') THEN 'SINAN/DATASUS' WHEN contains(p, 'liraa') THEN 'LIRAa/SES-RJ'
  WHEN contains(p, 'ripsa') THEN 'RIPSA/SES-RJ' WHEN contains(p, 'sinisa') THEN 'SINISA/Ministério das Cidades'
  WHEN contains(p, 'snis') THEN 'SNIS/Ministério das Cidades'
  WHEN contains(p, 'territorio') OR contains(p, 'ibge') OR contains(p, 'municip') THEN 'IBGE' ELSE 'fonte_mista_ou_derivada' END AS source
FROM (SELECT page_id, lower(url || CASE page_id % 8 WHEN 0 THEN '/SINAN/a' WHEN 1 THEN '/liraa' WHEN 2 THEN '/Ripsa' WHEN 3 THEN '/sinisa_snis'
  WHEN 4 THEN '/snis' WHEN 5 THEN '/malha_municipal' WHEN 6 THEN '/dengue_liraa' ELSE '' END) AS p FROM pages)""")
def source_class(v):
    tails = ["/SINAN/a", "/liraa", "/Ripsa", "/sinisa_snis", "/snis", "/malha_municipal", "/dengue_liraa", ""]
    tail = F.get(F.array(*[F.lit(t) for t in tails]), (F.col("page_id") % 8).cast("int"))
    return v.table("pages").select("page_id", tx.source_of_path(F.concat("url", tail)).alias("source"))


@query("code_name_split", r"""
SELECT c_custkey, regexp_extract(trim(t), '^([0-9]{6})\s+', 1) AS leading_code, trim(regexp_replace(trim(t), '^[0-9]{6}\s+', '')) AS rest
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 4 THEN c_name ELSE '33' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') || '  ' || c_name || ' ' END AS t FROM customer)""")
def code_name_split(v):
    text = F.when(F.col("c_custkey") % 9 == 4, F.col("c_name")).otherwise(
        F.concat(F.lit("33"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.lit("  "), "c_name", F.lit(" "))
    )
    return v.table("customer").select("c_custkey", text.alias("t")).select(
        "c_custkey", tx.leading_code("t").alias("leading_code"), tx.name_after_code("t").alias("rest")
    )


@query("standardise_columns", """
SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_mktsegment AS segment, '' AS brand, 'fonte' AS source FROM customer
UNION ALL SELECT 'part', p_partkey, p_name, '', p_brand, 'fonte' FROM part""")
def standardise_columns(v):
    """Two sources with different columns brought to one list; one column is left out."""
    people = v.table("customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), "c_acctbal",
    ).drop("c_acctbal")
    parts = v.table("part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")
    )
    joined = src.union_sources(people, parts)
    return reconcile.aligned_columns(joined, ["kind", "key", "name", "segment", "brand", "source"], {"source": "fonte"})


@query("component_rules", """
SELECT indicator, CASE WHEN indicator IN ('IN049', 'IN055') THEN 'abastecimento_agua' ELSE 'esgotamento_sanitario' END AS fact_rule,
  CASE WHEN indicator IN ('IN015', 'IN016', 'IN046', 'IN056') THEN 'esgotamento_sanitario' ELSE 'abastecimento_agua' END AS inventory_rule, count(*) AS rows
FROM indicator_fact GROUP BY 1""")
def component_rules(v):
    counted = v.indicators.groupBy("indicator").agg(F.count(F.lit(1)).alias("rows"))
    return whole(counted.select(
        "indicator", ind.fact_component("indicator").alias("fact_rule"), ind.inventory_component("indicator").alias("inventory_rule"), "rows"
    ))
