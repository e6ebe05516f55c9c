"""Data-quality gates: each returns its violations ``rule, key, detail``.

A gate passes when the frame is empty; the frame itself is the report of what
was rejected.  Groups are counted before anything moves, so a crowded key costs
one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import indicators as ind
from vigipanel.functions.text import clean_text
from vigipanel.session import cut_lineage

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_SCHEMA = "rule string, key string, detail string"


class QualityError(ValueError):
    """A gate that must pass did not."""


def violations(df: DataFrame, rule: str, key: Column, detail: Column | str) -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), text.cast("string").alias("detail"))


def gathered(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def enforce(frame: DataFrame) -> None:
    """Raise with a few examples when a gate has violations."""
    sample = frame.take(5)
    if sample:
        raise QualityError("; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in sample))


def _listed(spark: SparkSession, rule: str, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(rule, k, d) for k, d in rows], _SCHEMA)


def required_columns(df: DataFrame, required, rule: str = "required_columns") -> DataFrame:
    """Decided on the schema; no job runs."""
    missing = sorted(set(required) - set(df.columns))
    return _listed(df.sparkSession, rule, [(c, "missing") for c in missing])


def forbidden_columns(df: DataFrame, forbidden=fv.FORBIDDEN_IDENTIFIERS, rule: str = "forbidden_columns") -> DataFrame:
    present = sorted(set(forbidden) & set(df.columns))
    return _listed(df.sparkSession, rule, [(c, "present") for c in present])


def unique_key(df: DataFrame, keys: list[str], rule: str = "unique_key") -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return violations(repeated, rule, F.concat_ws("|", *keys), F.concat(F.lit("rows="), F.col("_n")))


def known_reference(df: DataFrame, column: str, dimension: DataFrame, dimension_column: str,
                    rule: str = "known_reference") -> DataFrame:
    used = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    known = dimension.select(F.col(dimension_column).alias("_v"))
    return violations(
        used.join(known, "_v", "left_anti"), rule, F.coalesce("_v", F.lit("")), F.concat(F.lit("rows="), F.col("_n"))
    )


def value_domain(df: DataFrame, column: str, allowed, exact: bool = False, rule: str = "value_domain") -> DataFrame:
    """Values outside the domain; with ``exact`` also domain values that never occur."""
    spark = df.sparkSession
    seen = df.groupBy(F.col(column).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    domain = spark.createDataFrame([(str(v),) for v in allowed], "_v string")
    seen = cut_lineage(seen) if exact else seen
    out = violations(
        seen.join(domain, "_v", "left_anti"), rule, F.coalesce("_v", F.lit("")),
        F.concat(F.lit("unexpected rows="), F.col("_n")),
    )
    if exact:
        out = out.unionByName(violations(domain.join(seen, "_v", "left_anti"), rule, F.col("_v"), "missing"))
    return out


def year_coverage(df: DataFrame, column: str, first_year: int, last_year: int, mode: str = "exact",
                  rule: str = "year_coverage") -> DataFrame:
    """``subset``: no year outside; ``exact``: all years too; ``contiguous``: no gap from the first year on."""
    spark = df.sparkSession
    seen = df.select(F.col(column).cast("int").alias("_y")).distinct()
    outside = violations(
        seen.where(~F.coalesce(F.col("_y").between(first_year, last_year), F.lit(False))),
        rule, F.coalesce(F.col("_y").cast("string"), F.lit("")), "outside",
    )
    if mode == "subset":
        return outside
    wanted = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("_y"))
    if mode == "contiguous":
        latest = df.agg(F.max(F.col(column).cast("int"))).scalar()
        wanted = wanted.where(F.col("_y") <= latest)
    return outside.unionByName(
        violations(wanted.join(seen, "_y", "left_anti"), rule, F.col("_y").cast("string"), "missing")
    )


def complete_grid(df: DataFrame, grid: DataFrame, keys: list[str], rule: str = "complete_grid") -> DataFrame:
    """Cells of the expected grid that are missing, and cells outside it."""
    cells = df.select(*keys).distinct()
    wanted = grid.select(*keys).distinct()
    key = F.concat_ws("|", *keys)
    return violations(wanted.join(cells, keys, "left_anti"), rule, key, "missing").unionByName(
        violations(cells.join(wanted, keys, "left_anti"), rule, key, "unexpected")
    )


def row_count(df: DataFrame, expected: DataFrame, rule: str = "row_count") -> DataFrame:
    """``expected`` holds one row with one count, computed from dimension and calendar."""
    wanted = expected.select(F.col(expected.columns[0]).alias("_e"))
    found = df.agg(F.count(F.lit(1)).alias("_f")).withColumn("_e", wanted.scalar())
    return violations(
        found.where(F.col("_f") != F.col("_e")), rule, F.lit("rows"),
        F.concat(F.lit("expected="), "_e", F.lit(" found="), "_f"),
    )


def control_totals(df: DataFrame, key: str, value: str, expected: DataFrame, rule: str = "control_totals") -> DataFrame:
    """``expected``: key, ``total``."""
    found = df.groupBy(key).agg(F.sum(value).alias("_f"))
    both = found.join(expected.select(key, F.col("total").alias("_e")), key, "full_outer")
    return violations(
        both.where(~F.col("_f").eqNullSafe(F.col("_e"))), rule, F.col(key).cast("string"),
        F.concat(F.lit("expected="), F.coalesce(F.col("_e").cast("string"), F.lit("none")),
                 F.lit(" found="), F.coalesce(F.col("_f").cast("string"), F.lit("none"))),
    )


def sign(df: DataFrame, column: str, key: Column, positive: bool = False, rule: str = "sign") -> DataFrame:
    value = F.col(column)
    bad = (value <= 0) | value.isNull() if positive else value < 0
    return violations(df.where(bad), rule, key, F.concat(F.lit(f"{column}="), F.coalesce(value.cast("string"), F.lit("null"))))


def incidence_domain(df: DataFrame, cases: str, population: str, key: Column, rule: str = "incidence_domain") -> DataFrame:
    """Rows for which an incidence is not defined: negative or missing cases, no positive population."""
    fine = F.coalesce(ind.incidence_domain(cases, population), F.lit(False))
    return violations(df.where(~fine), rule, key, F.concat_ws(
        ",", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in (cases, population)]))


def code_prefix(df: DataFrame, column: str, prefix: str, rule: str = "code_prefix") -> DataFrame:
    codes = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    bad = ~F.coalesce(F.col("_v").startswith(prefix), F.lit(False))
    return violations(codes.where(bad), rule, F.coalesce("_v", F.lit("")), F.concat(F.lit("rows="), F.col("_n")))


def neighbour_graph(edges: DataFrame, areas: DataFrame, symmetric: bool = True, tolerance: float = 1e-10) -> DataFrame:
    """Coverage, isolates, symmetry and row weights of one edge table ``src, dst, weight``."""
    edges = cut_lineage(edges.select("src", "dst", "weight"))
    codes = areas.select(F.col("code").alias("_v"))
    sources = edges.groupBy(F.col("src").alias("_v")).agg(F.sum("weight").alias("_w"))
    out = [
        violations(codes.join(sources, "_v", "left_anti"), "graph_isolate", F.col("_v"), "no neighbour"),
        violations(sources.join(codes, "_v", "left_anti"), "graph_unknown", F.col("_v"), "not an area"),
        violations(
            sources.where(F.abs(F.col("_w") - 1) > tolerance), "graph_weights", F.col("_v"),
            F.concat(F.lit("sum="), F.round("_w", 6)),
        ),
    ]
    if symmetric:
        pairs = edges.select("src", "dst").distinct()
        back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        out.append(violations(
            pairs.join(back, ["src", "dst"], "left_anti"), "graph_symmetry", F.concat_ws("|", "src", "dst"), "no way back"
        ))
    return gathered(*out)


def run_payload(run: DataFrame) -> DataFrame:
    """Not empty, exactly one run id, each time once."""
    ids = F.count_distinct(F.when(F.trim("execution_id") != "", F.col("execution_id")))
    facts = run.agg(F.count(F.lit(1)).alias("_n"), ids.alias("_ids"))
    times = run.groupBy("tempo").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return gathered(
        violations(facts.where(F.col("_n") == 0), "run_empty", F.lit("rows"), "0"),
        violations(facts.where(F.col("_ids") != 1), "run_id", F.lit("execution_id"), F.concat(F.lit("distinct="), F.col("_ids"))),
        violations(times, "run_time", F.col("tempo").cast("string"), F.concat(F.lit("rows="), F.col("_n"))),
    )


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: manifest rows, verified, missing, mismatched, passed.

    ``manifest`` and ``files`` hold ``path, sha256``.  A manifest row without
    path or hash is never verified, so it makes the check fail.
    """
    wanted = manifest.select(clean_text("path").alias("path"), F.lower(clean_text("sha256")).alias("_e"))
    found = files.select("path", F.lower("sha256").alias("_f"))
    usable = (F.col("path") != "") & (F.col("_e") != "")
    joined = wanted.join(found, "path", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("manifest_rows"),
        F.count_if(usable & (F.col("_f") == F.col("_e"))).alias("verified"),
        F.count_if(usable & F.col("_f").isNull()).alias("missing"),
        F.count_if(usable & (F.col("_f") != F.col("_e"))).alias("mismatched"),
    ).withColumn("passed", (F.col("manifest_rows") > 0) & (F.col("verified") == F.col("manifest_rows")))


def credential_lines(texts: DataFrame, key: str, text: str, patterns=fv.CREDENTIAL_PATTERNS) -> DataFrame:
    """``key:line`` of every line that looks like a credential; the value stays out."""
    hit = reduce(lambda a, b: a | b, [F.col("_line").rlike(f"(?U){p}") for p in patterns])
    whole = reduce(lambda a, b: a | b, [F.col(text).rlike(f"(?U){p}") for p in patterns])
    lines = (
        texts.where(whole)      # most texts hold none and are not split
        .select(F.col(key).cast("string").alias("_k"), F.posexplode(F.split(text, _LINE_BREAK)).alias("_p", "_line"))
        .where(hit)
    )
    return violations(lines, "credential", F.concat(F.col("_k"), F.lit(":"), F.col("_p") + 1), "possible credential")


def oversized(files: DataFrame, limit: int = fv.OVERSIZE_LIMIT) -> DataFrame:
    return violations(files.where(F.col("length") > limit), "oversized", F.col("path"), F.concat(F.lit("bytes="), F.col("length")))


def payload_signature(files: DataFrame, default_format: str | None = None) -> DataFrame:
    """Files whose first bytes do not belong to their extension; ``files``: ``path, content``."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    if default_format:
        kind = F.lit(default_format)
    head = F.hex(F.substring("content", 1, 8))
    fits = F.lit(False)
    for name, signatures in fv.PAYLOAD_SIGNATURES.items():
        for signature in signatures:
            fits = fits | ((kind == name) & head.startswith(signature))
    allowed = kind.isin(*fv.PAYLOAD_SIGNATURES)
    return violations(
        files.where(~fits), "payload_signature", F.col("path"),
        F.when(allowed, F.lit("signature does not fit")).otherwise(F.lit("format not allowed")),
    )


def error_pages(pages: DataFrame, key: str, html: str, markers=fv.ERROR_MARKERS) -> DataFrame:
    """Error pages served as success, and empty payloads."""
    head = F.lower(F.substring(F.col(html).cast("binary"), 1, fv.ERROR_PREFIX_BYTES).cast("string"))
    marked = reduce(lambda a, b: a | b, [head.contains(m) for m in markers])
    empty = F.coalesce(F.length(html), F.lit(0)) == 0
    disguised = head.contains("<html") & marked
    return violations(
        pages.where(empty | disguised), "error_page", F.col(key), F.when(empty, "empty payload").otherwise("error page")
    )


def spatial_ready(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Years in which an area of the graph has no value, and years of constant values."""
    values = cut_lineage(values.select("year", "code", "value"))
    graph = cut_lineage(edges.select(F.col("src").alias("code")).distinct())
    years = values.select("year").distinct()
    held = values.where(F.col("value").isNotNull()).select("code", "year")
    per_year = held.join(graph, "code", "left_semi").groupBy("year").agg(F.count_distinct("code").alias("_n"))
    size = graph.agg(F.count(F.lit(1))).scalar()
    short = years.join(per_year, "year", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_all", size)
    flat = values.groupBy("year").agg((F.max("value") == F.min("value")).alias("_flat"))
    return gathered(
        violations(
            short.where(F.col("_n") < F.col("_all")), "spatial_missing", F.col("year").cast("string"),
            F.concat(F.lit("areas without value="), F.col("_all") - F.col("_n")),
        ),
        violations(flat.where("_flat"), "spatial_constant", F.col("year").cast("string"), "constant values"),
    )
