"""Files, sheets, pages and sinks: views are written in a source form and read back.

What is written goes to the shared folder the session names, one new path per
call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import values as val
from vigipanel.operators import cells, quality as dq, series, summary
from vigipanel.plans.registry import query
from vigipanel.plans.views import FIRST_YEAR, LAST_YEAR, MEASURES, whole
from vigipanel.session import fresh_path
from vigipanel.sinks import lookup, tables as sinks, versions
from vigipanel.sources import documents, files, tables as src

YEARS = list(range(FIRST_YEAR, LAST_YEAR + 1))


def _artefacts(v, content: bool = False):
    """Documents and pages as stored artefacts: path, length and content of each."""
    texts = v.table("documents").select(F.format_string("documents/%d.txt", "doc_id").alias("path"), "text").unionByName(
        v.table("pages").select(F.format_string("pages/%d.html", "page_id").alias("path"), F.col("html").alias("text")))
    return texts.select("path", F.octet_length("text").cast("long").alias("length"), *([F.encode("text", "UTF-8").alias("content")] if content else []))


def fv_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ARTEFACT = """artefact AS (SELECT 'documents/' || doc_id || '.txt' AS path, text FROM documents UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages)"""


@query("file_manifest", f"WITH {ARTEFACT} SELECT path, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS sha256 FROM artefact")
def file_manifest(v):
    return files.content_hashes(_artefacts(v, content=True))


@query("file_sizes", f"""
WITH {ARTEFACT} SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, CAST(max(strlen(text)) AS BIGINT) AS largest_bytes,
  count(*) FILTER (WHERE strlen(text) > 8192) AS files_over_limit FROM artefact""")
def file_sizes(v):
    return summary.file_statistics(_artefacts(v), 8192)


@query("oversize_files", f"""
WITH {ARTEFACT} SELECT 'oversized' AS rule, path AS key, 'bytes=' || strlen(text) AS detail FROM artefact WHERE strlen(text) > 8192""")
def oversize_files(v):
    return dq.oversized(_artefacts(v), 8192)


@query("payload_signature", f"""
WITH {ARTEFACT} SELECT 'payload_signature' AS rule, path AS key, 'format not allowed' AS detail FROM artefact WHERE path LIKE '%.txt'
UNION ALL SELECT 'payload_signature', 'pages/' || page_id || '.html.zip', 'signature does not fit' FROM pages WHERE page_id % 2 = 0""")
def payload_signature(v):
    """Texts are no allowed payload; every page claims to be a ZIP file, and every second one begins as such."""
    page = F.col("path").startswith("pages/")
    odd = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 2 == 1
    begun = F.when(page & odd, F.concat(F.unhex(F.lit("504B0304")), "content")).otherwise(F.col("content"))
    named = F.when(page, F.concat("path", F.lit(".zip"))).otherwise(F.col("path"))
    return dq.payload_signature(_artefacts(v, content=True).select(named.alias("path"), begun.alias("content")))


@query("latest_file", """
SELECT event_type AS kind, arg_max('events/' || event_id, (ts, 'events/' || event_id)) AS path, max(ts) AS "modificationTime" FROM events GROUP BY 1""")
def latest_file(v):
    """The newest artefact of each kind, by event time."""
    listed = v.table("events").select(F.format_string("events/%d", "event_id").alias("path"), F.col("ts").alias("modificationTime"), "event_type")
    return files.newest(listed, F.col("event_type"))


@query("manifest_check", f"""
WITH {ARTEFACT}, n AS (SELECT count(*) AS all_rows, count(*) FILTER (WHERE path LIKE '%7.txt') AS gone, count(*) FILTER (WHERE path LIKE '%3.html') AS changed FROM artefact)
SELECT all_rows AS manifest_rows, all_rows - gone - changed AS verified, gone AS missing, changed AS mismatched, gone + changed = 0 AS passed FROM n""")
def manifest_check(v):
    """The artefacts against their own manifest with some hashes changed and some paths gone."""
    found = files.content_hashes(_artefacts(v, content=True))
    manifest = found.select(
        F.when(F.col("path").endswith("7.txt"), F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("path").endswith("3.html"), F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
    )
    return whole(dq.manifest_check(manifest, found))


@query("file_shape", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS columns FROM annual""")
def file_shape(v):
    """Rows and header width of an exported table, over all its part files."""
    path = fresh_path(v.spark, "shape")
    sinks.export_csv(v.annual, path)
    shaped = files.with_shape(v.spark, path, files.listing(v.spark, path))
    return whole(shaped.where(F.col("length") > 0).agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns")))


@query("file_control", f"""
WITH part AS (SELECT c_custkey // 200 AS folder, c_custkey, c_custkey || ',"' || c_name || chr(10) || 'of nation ' || c_nationkey || '",' || c_mktsegment AS line FROM customer),
file AS (SELECT folder, count(*) AS n, 'c_custkey,label,c_mktsegment' || chr(10) || string_agg(line, chr(10) ORDER BY c_custkey) || chr(10) AS content FROM part GROUP BY 1)
SELECT 'raw/ripsa/list=' || folder AS arquivo, 'raw' AS camada, {fv_literal("RIPSA/SES-RJ")} AS fonte, CAST(n AS BIGINT) AS quantidade_linhas, CAST(3 AS BIGINT) AS quantidade_colunas,
  sha256(content) AS hash_sha256, '' AS arquivo_origem, {fv_literal(fv.FILE_STATUS)} AS status_validacao FROM file""")
def file_control(v):
    """The control table of a tree of files: two hundred customers each, one field of which spans two lines."""
    path = fresh_path(v.spark, "control")
    label = F.concat("c_name", F.lit("\nof nation "), "c_nationkey")
    rows = v.table("customer").select(F.floor(F.col("c_custkey") / 200).alias("list"), "c_custkey", label.alias("label"), "c_mktsegment")
    rows.repartition("list").sortWithinPartitions("list", "c_custkey").write.partitionBy("list").option("header", True).csv(f"{path}/raw/ripsa")
    return whole(files.file_control(v.spark, path, "1").select(
        F.regexp_replace("arquivo", "/[^/]*$", "").alias("arquivo"), "camada", "fonte", "quantidade_linhas", "quantidade_colunas", "hash_sha256", "arquivo_origem", "status_validacao",
    ))


@query("csv_contract", "SELECT code, year, CAST(population AS BIGINT) AS population FROM population")
def csv_contract(v):
    path = fresh_path(v.spark, "contract")
    sinks.export_csv(v.population, path)
    return whole(src.typed_csv(v.spark, path, "code string, year int, population bigint"))


@query("csv_export", "SELECT code, month, probable_cases, discarded_cases FROM monthly")
def csv_export(v):
    path = fresh_path(v.spark, "export")
    sinks.export_csv(v.monthly.select("code", "month", "probable_cases", "discarded_cases"), path)
    return src.typed_csv(v.spark, path, "code string, month date, probable_cases bigint, discarded_cases bigint")


@query("record_scan", """
SELECT base_year, code, symptom_date, notification_date, delay_days, symptom_week, class_code, class_label, discarded, probable FROM record""")
def record_scan(v):
    """National record files with identifiers, in Latin-1, read, cut, typed."""
    path = fresh_path(v.spark, "national")
    national = v.staged.select(
        F.lit("Conceição").alias("NM_PACIENT"), F.date_format("notification_date", "yyyyMMdd").alias("DT_NOTIFIC"),
        F.lit("").alias("SEM_NOT"), F.col("symptom_date").cast("string").alias("DT_SIN_PRI"),
        F.col("symptom_week").alias("SEM_PRI"), F.concat(F.lit(" "), "residence_code").alias("ID_MN_RESI"),
        F.lit("F").alias("CS_SEXO"), F.lit("4030").alias("NU_IDADE_N"), F.col("class_code").alias("CLASSI_FIN"),
        F.lit("1").alias("CRITERIO"), F.lit("1").alias("EVOLUCAO"), F.lit("").alias("DT_OBITO"), F.lit("").alias("DT_ENCERRA"),
        F.lit("").alias("SOROTIPO"), F.col("base_year").alias("year"),
    )
    # the base year travels in the folder name, as it does in published file names
    national.write.partitionBy("year").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    raw = (
        v.spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
        .withColumn("_file", F.col("year").cast("string"))
    )
    fact = series.typed_records(src.staged_records(src.residents_only(raw, v.area)), first_text_dates=True)
    return whole(fact.drop("criterion", "residence_code"))


@query("encoding_fallback", """
SELECT p.code, a.name || ' Conceição' AS area_name, p.year, CAST(p.population AS BIGINT) AS population, 'RIPSA/SES-RJ' AS source,
  CASE WHEN a.key % 2 = 0 THEN 'latin-1' ELSE 'utf-8-sig' END AS source_encoding FROM population p JOIN area a ON a.code = p.code""")
def encoding_fallback(v):
    """Wide population files, half of them Latin-1, half UTF-8, read by one operator."""
    path = fresh_path(v.spark, "wide")
    label = F.concat(F.left("code", F.lit(6)), F.lit(" "), "name", F.lit(" Conceição"))
    wide = (
        v.population.join(v.area.select("code", "name", "key"), "code")
        .groupBy(label.alias("Município"), "key").pivot("year", YEARS).agg(F.first("population"))
    )
    for rest, encoding in ((0, "ISO-8859-1"), (1, "UTF-8")):
        wide.where(F.col("key") % 2 == rest).drop("key").write.option("header", True).option("sep", ";").option(
            "encoding", encoding).csv(f"{path}/e{rest}")
    return whole(files.population_series(files.decoded_csv(v.spark, path, pattern="*.csv"), v.area, YEARS))


@query("paged_json", """
SELECT code, CAST(year AS BIGINT) AS ano, CAST(provider_code AS VARCHAR) AS codigo_prestador, t.legacy AS indicator,
  try_cast(replace(raw_value, ',', '.') AS DOUBLE) AS value, 'percentual' AS unit, 'prestador-municipio-ano' AS source_level FROM provider_text t
UNION ALL SELECT code, year, CAST(provider_code AS VARCHAR), 'IN016', NULL, 'percentual', 'prestador-municipio-ano' FROM provider_year""")
def paged_json(v):
    """Provider rows as grid pages (one page per provider and year), read and unpivoted."""
    path = fresh_path(v.spark, "pages")
    plain = {m[0]: F.replace(F.col(m[0]), F.lit(","), F.lit(".")) for m in MEASURES}
    fixed = {
        "codigo_municipio_snis": F.left("code", F.lit(6)), "nome_municipio_origem": F.lit("n"), "uf": F.lit("RJ"),
        "ano": F.col("year").cast("string"), "codigo_prestador": F.col("provider_code").cast("string"),
        "nome_prestador": F.col("provider_name"), **plain,
    }
    cell = F.array(*[fixed.get(n, F.lit("")) for n in fv.GRID_COLUMNS])
    v.indicators_wide.select(
        F.lit("ok").alias("status"), F.array(F.struct(cell.alias("cell"))).alias("rows")
    ).write.json(path)
    pages = documents.grid_pages(v.spark, path, multi_line=False)
    long = documents.grid_indicators(documents.grid_rows(pages), v.area)
    return whole(long.select("code", "ano", "codigo_prestador", "indicator", "value", "unit", "source_level"))


@query("json_dimension", "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name FROM customer")
def json_dimension(v):
    """Lists of a hundred places each, written as JSON and read back."""
    path = fresh_path(v.spark, "areas")
    lists = v.table("customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("list")).agg(F.to_json(F.collect_list(F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("nome")))).alias("value"))
    lists.select("value").write.text(path)
    return documents.area_list(v.spark, path, multi_line=False)


@query("union_sources", """
SELECT 'survey' AS kind, code, year, count(*) AS rows FROM survey GROUP BY 2, 3 UNION ALL SELECT 'annual', code, year, count(*) FROM annual GROUP BY 2, 3""")
def union_sources(v):
    both = src.union_sources(
        v.survey.select(F.lit("survey").alias("kind"), "code", "year", "status"),
        v.annual.select(F.lit("annual").alias("kind"), "code", "year", "time_axis"),
    )
    return whole(both.groupBy("kind", "code", "year").agg(F.count(F.lit(1)).alias("rows")))


@query("name_attributes", """
SELECT 'LIRAa_' || year || '_' || lpad(CAST(month AS VARCHAR), 2, '0') || '.xlsx' AS name, year, month, count(*) AS areas FROM survey GROUP BY year, month""")
def name_attributes(v):
    named = v.survey.select(F.format_string("LIRAa_%04d_%02d.xlsx", "year", "month").alias("name"))
    year, month = src.year_month_of_name("name", "LIRAa_")
    return whole(named.groupBy("name").agg(F.count(F.lit(1)).alias("areas")).select("name", year, month, "areas"))


@query("source_attributes", """
WITH f AS (SELECT indicator, value, CASE year % 3 WHEN 0 THEN 'sinisa_residuos_solidos_' WHEN 1 THEN 'sinisa_aguas_pluviais_' ELSE 'snis_prestadores_' END || year || '.csv' AS name FROM area_indicator)
SELECT name, indicator, CASE WHEN starts_with(name, 'sinisa_') THEN 'SINISA' ELSE 'SNIS' END AS system,
  CASE WHEN contains(name, 'residuos_solidos') THEN 'residuos_solidos' WHEN contains(name, 'aguas_pluviais') THEN 'aguas_pluviais'
       WHEN indicator IN ('IN049', 'IN055') THEN 'abastecimento_agua' ELSE 'esgotamento_sanitario' END AS component,
  CASE WHEN value IS NULL THEN 'ausente' ELSE 'observado' END AS status, count(*) AS rows FROM f GROUP BY ALL""")
def source_attributes(v):
    """System and component from the names of source files, and the status of sources that only give numbers."""
    start = F.when(F.col("year") % 3 == 0, "sinisa_residuos_solidos_").when(F.col("year") % 3 == 1, "sinisa_aguas_pluviais_").otherwise("snis_prestadores_")
    named = v.area_indicators.select(F.concat(start, F.col("year").cast("string"), F.lit(".csv")).alias("name"), "indicator", "value")
    return whole(named.groupBy(
        "name", "indicator", src.system_of_name("name").alias("system"), src.component_of_name("name", "indicator").alias("component"), val.numeric_status("value").alias("status"),
    ).agg(F.count(F.lit(1)).alias("rows")))


SHEET_LAYOUT = cells.Layout(
    component=fv.WATER, year=FIRST_YEAR, state_col=2, code_col=0, name_col=1, name_offset=-3, formula_offset=-2,
    unit_offset=-1, family_offset=-4, family_merged=True, provider_name_col=3, pattern=fv.LEGACY_CODE_PATTERN,
)


def _indicator_cells(v):
    """Provider rows as sheets, one per year: merged family, name, formula, unit, code, data."""
    def cell(row, col, value):
        return F.struct(F.lit(row).cast("long").alias("row") if isinstance(row, int) else row.alias("row"),
                        F.lit(col).alias("col"), value.alias("value"))

    sheet = [F.concat(F.lit("base_"), F.col("year").cast("string")).alias("file"), F.lit("1").alias("sheet")]
    heads = [cell(4, 0, F.lit("cod_IBGE")), cell(4, 1, F.lit("Município")), cell(4, 2, F.lit("UF"))]
    for i, (legacy, _, _, _) in enumerate(MEASURES):
        if i in (0, 2):
            heads.append(cell(0, 4 + i, F.lit("Família A" if i == 0 else "Família B")))
        heads += [cell(1, 4 + i, F.lit(f" nome {legacy}")), cell(2, 4 + i, F.lit(f"f({legacy})")),
                  cell(3, 4 + i, F.lit("%")), cell(4, 4 + i, F.lit(legacy))]
    row = F.col("provider_code") + 6
    body = [cell(row, 0, F.concat("code", F.lit(".0"))), cell(row, 1, F.lit("n")), cell(row, 2, F.lit("RJ ")),
            cell(row, 3, F.col("provider_name"))]
    body += [cell(row, 4 + i, F.col(m[0])) for i, m in enumerate(MEASURES)]
    head_rows = v.indicators_wide.select("year").distinct().select(*sheet, F.explode(F.array(*heads)).alias("c"))
    body_rows = v.indicators_wide.select(*sheet, F.explode(F.array(*body)).alias("c"))
    return head_rows.unionByName(body_rows).select("file", "sheet", "c.*")


@query("cell_grid_normalise", """
SELECT 'base_' || year AS file, code AS source_code, provider_name, CASE WHEN legacy IN ('IN055', 'IN049') THEN 'Família A' ELSE 'Família B' END AS family,
  legacy AS indicator, 'nome ' || legacy AS name, 'f(' || legacy || ')' AS formula, '%' AS unit, raw_value,
  try_cast(replace(raw_value, ',', '.') AS DOUBLE) AS value,
  CASE WHEN raw_value = '' THEN 'ausente' WHEN try_cast(replace(raw_value, ',', '.') AS DOUBLE) IS NULL THEN raw_value ELSE 'observado' END AS value_status
FROM provider_text""")
def cell_grid_normalise(v):
    grid = _indicator_cells(v)
    headers = cells.header_with_most_codes(grid, fv.LEGACY_CODE_PATTERN)
    long = cells.indicator_rows(grid, headers, SHEET_LAYOUT)
    return whole(long.select("file", "source_code", "provider_name", "family", "indicator", "name", "formula", "unit", "raw_value", "value", "value_status"))


@query("sheet_headers", """
SELECT 'base_' || year AS file, CAST(4 AS BIGINT) AS by_token, CAST(4 AS BIGINT) AS by_count, CAST(4 AS BIGINT) AS first_code, min(provider_code) + 6 AS data_row,
  CAST(2 AS BIGINT) AS state_column, CAST(1 AS BIGINT) AS state_matches FROM provider_year GROUP BY year""")
def sheet_headers(v):
    """Header and data rows of every sheet, found in the four published ways."""
    grid = _indicator_cells(v)
    token = cells.header_with_token(grid, "cod_IBGE")
    key = cells.SHEET
    return whole(
        token.withColumnRenamed("header_row", "by_token")
        .join(cells.header_with_most_codes(grid, fv.LEGACY_CODE_PATTERN).withColumnRenamed("header_row", "by_count"), key)
        .join(cells.first_code_row(grid).withColumnRenamed("header_row", "first_code"), key)
        .join(cells.first_numeric_row(grid, token), key)
        .join(cells.columns_by_code(grid, token, "UF").withColumnRenamed("column", "state_column")
              .withColumnRenamed("matches", "state_matches"), key)
        .drop("sheet")
    )


@query("survey_sheet", """
SELECT left(code, 6) AS source_code, year, month, reference_date, iip AS iip_aedes_aegypti, ib AS ib_aedes_aegypti,
  CASE WHEN iip IS NOT NULL THEN 'observado' WHEN period_text <> '' THEN 'justificativa' ELSE 'nao_informado' END AS status, ib > 100 AS outlier FROM survey_values""")
def survey_sheet(v):
    """Survey rounds as sheets (one per round) and back."""
    letter = F.when(F.col("status") == fv.JUSTIFIED, "OFÍCIO com justificativa").otherwise("")

    def cell(row, col, value):
        return F.struct(row.cast("long").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))

    sheet = [F.format_string("LIRAa_%04d_%02d", "year", "month").alias("file"), F.lit("1").alias("sheet")]
    row = F.left("code", F.lit(6)).cast("long") - 330000 + 3
    body = [cell(row, 0, F.left("code", F.lit(6))), cell(row, 1, F.lit("n")), cell(row, 2, F.lit("RJ")), cell(row, 3, letter),
            cell(row, 4, F.col("iip")), cell(row, 5, F.col("ib"))]
    head = v.survey.select("year", "month").distinct().select(*sheet, F.explode(F.array(
        cell(F.lit(2), 0, F.lit(" IBGE")), cell(F.lit(0), 0, F.lit("Levantamento")))).alias("c"))
    grid = head.unionByName(v.survey.select(*sheet, F.explode(F.array(*body)).alias("c"))).select("file", "sheet", "c.*")
    return whole(cells.survey_rows(grid).select(
        "source_code", "year", "month", "reference_date", "iip_aedes_aegypti", "ib_aedes_aegypti", "status", "outlier"
    ))


@query("forward_fill", """
SELECT code AS file, CAST(year(month) AS BIGINT) AS row, CAST(month(month) AS BIGINT) AS col, last_value(CASE WHEN month(month) IN (1, 4, 7, 10) THEN CAST(probable_cases AS VARCHAR) END IGNORE NULLS)
  OVER (PARTITION BY code, year(month) ORDER BY month) AS value FROM monthly""")
def forward_fill(v):
    quarterly = v.monthly.select(
        F.col("code").alias("file"), F.lit("s").alias("sheet"), F.year("month").alias("row"), F.month("month").alias("col"),
        F.when(F.month("month").isin(1, 4, 7, 10), F.col("probable_cases").cast("string")).alias("value"),
    )
    return whole(cells.filled_across(quarterly).drop("sheet"))


@query("stage_and_replace", "SELECT code, year, probable_cases, CAST(population AS BIGINT) AS population FROM annual")
def stage_and_replace(v):
    """A gated load that replaces a table, then the table read by name."""
    name = "vigipanel_annual_" + fresh_path(v.spark, "t").rsplit("-", 1)[1]
    frame = v.annual.select("code", "year", "probable_cases", "population")
    sinks.load_table(frame.limit(0), name)
    sinks.load_table(frame, name, [lambda written: dq.unique_key(written, ["code", "year"])])
    loaded = v.spark.table(name)                     # resolved to its files, which stay
    v.spark.sql(f"DROP TABLE {name}")
    return whole(loaded.drop("_ingested_at"))


@query("indexed_lookup", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders) OR o_custkey IN (SELECT min(o_custkey) FROM orders)""")
def indexed_lookup(v):
    """Orders laid out by their key, found by the key and by the scattered customer."""
    path = fresh_path(v.spark, "lookup")
    orders = v.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lookup.write_lookup(orders, path, ["o_orderkey"], ["o_custkey"])
    last, customer = orders.agg(F.max("o_orderkey"), F.min("o_custkey")).first()
    held = v.spark.read.parquet(path)
    by_key = held.where(F.col("o_orderkey") == last)
    return whole(by_key.unionByName(held.where((F.col("o_custkey") == customer) & (F.col("o_orderkey") != last))))


@query("publish_aggregates", """
SELECT 'annual' AS name, count(*) AS rows FROM annual UNION ALL SELECT 'monthly', count(*) FROM monthly UNION ALL SELECT 'area', count(*) FROM area""")
def publish_aggregates(v):
    folder = fresh_path(v.spark, "published")
    offered = {"annual": v.annual, "monthly": v.monthly, "area": v.area, "records": v.records}
    names = sinks.publish_aggregates(offered, ("annual", "monthly", "area"), ("records",), folder, "annual")
    counts = [
        v.spark.read.parquet(f"{folder}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names
    ]
    return dq.gathered(*counts)


@query("append_run_guard", """
SELECT 'base' AS execution_id, CAST(day AS DOUBLE) AS tempo, round(sum(susceptible), 6) + 0.0 AS susceptible, round(sum(infected), 6) + 0.0 AS infected, round(sum(removed), 6) + 0.0 AS removed,
  round(sum(population), 6) + 0.0 AS population, CAST(1 AS BIGINT) AS stored FROM run_rows WHERE execution_id = 'base' GROUP BY day""")
def append_run_guard(v):
    """The run of all areas together is stored once and refused the second time."""
    path = fresh_path(v.spark, "runs")
    total = v.runs("base").groupBy("execution_id", "day").agg(
        *[F.sum(c).alias(c) for c in ("susceptible", "infected", "removed", "population")],
        F.avg("basic_reproduction").alias("basic_reproduction_number"),
    )
    run = total.select(
        "execution_id", F.lit("33").alias("codigo_ibge_municipio"), F.lit("todos").alias("municipio"), F.col("day").alias("tempo"),
        F.lit("base").alias("cenario"), "susceptible", "infected", "removed", F.lit(0.0).alias("new_infections"),
        F.lit(0.0).alias("new_removals"), F.lit(0.5).alias("beta"), F.lit(0.25).alias("gamma"), "basic_reproduction_number",
        F.try_divide(F.col("basic_reproduction_number") * F.col("susceptible"), F.col("population")).alias("effective_reproduction_number"),
        "population", F.lit("1").alias("model_version"),
    )
    sinks.append_run(run, path)
    try:
        sinks.append_run(run, path)
    except dq.QualityError:
        pass
    kept = v.spark.read.parquet(path)
    return whole(kept.groupBy("execution_id", "tempo", "susceptible", "infected", "removed", "population").agg(F.count(F.lit(1)).alias("stored")))


@query("tables_together", """
SELECT 'annual' AS name, code, year AS period, probable_cases AS cases, CAST(1 AS BIGINT) AS version FROM annual
UNION ALL SELECT 'monthly', code, CAST(year(month) * 100 + month(month) AS BIGINT), probable_cases, CAST(1 AS BIGINT) FROM monthly""")
def tables_together(v):
    """Two tables published as one version; a second version of which one table fails its gate moves neither."""
    folder = fresh_path(v.spark, "set")
    offered = {"annual": v.annual, "monthly": v.monthly}
    versions.publish_set(offered, folder, [lambda t: dq.unique_key(t["annual"], ["code", "year"]), lambda t: dq.unique_key(t["monthly"], ["code", "month"])])
    try:
        doubled = {"annual": v.annual.limit(0), "monthly": v.monthly.unionByName(v.monthly)}
        versions.publish_set(doubled, folder, [lambda t: dq.unique_key(t["monthly"], ["code", "month"])])
    except dq.QualityError:
        pass
    held = versions.read_set(v.spark, folder)
    at = F.lit(versions.current_version(v.spark, folder)).cast("long").alias("version")
    month = F.year("month") * 100 + F.month("month")
    return whole(held["annual"].select(F.lit("annual").alias("name"), "code", F.col("year").alias("period"), F.col("probable_cases").alias("cases"), at).unionByName(
        held["monthly"].select(F.lit("monthly").alias("name"), "code", month.alias("period"), F.col("probable_cases").alias("cases"), at)))
