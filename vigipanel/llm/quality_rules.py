"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Counts of a text are array expressions within its row: no shuffle and no
Python.  Repeated five-word windows are looked for by 64-bit hashes first; only
a text with equal hashes compares the windows themselves.  The rules behind the
base rule are measured on a bounded sample (``SAMPLE_ROWS`` rows): the time a
rule takes and the share it rejects.  They then form one CASE in the order of
rejection per second, so a dear rule only sees what cheaper ones let through.
The order changes the cost, never the verdict.

Edge cases: a null or blank text has no words, all counts are 0 and it fails
the base rule.  Repeated rows each get their own result; an empty table gives an
empty result; extra columns are not looked at.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from vigipanel.llm.bound import bound
from vigipanel.session import cut_lineage

SAMPLE_ROWS = 2000
WINDOW = 5
BLANK = " \t\n\x0b\f\r"
SPACES = r"[ \x09-\x0D]"

# name, the text fails when the SQL condition holds
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "exclamations": "10 * regexp_count(text, '!') > n_words",
    "capitals": "10 * regexp_count(text, '[A-Z]') > 3 * regexp_count(text, '[A-Za-z]')",
    "repeated_lines": "10 * n_dup_lines > 3 * (1 + regexp_count(text, '\\n'))",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_letters": "2 * regexp_count(text, '[A-Za-z\\\\x{80}-\\\\x{10FFFF}]') < word_chars",
    "ellipses": "10 * regexp_count(text, '\\\\.\\\\.\\\\.') > n_words",
}


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the base counts."""
    text = F.col("text")
    trimmed = F.btrim(text, F.lit(BLANK))
    split = bound(
        docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")), "doc_id", "text",
        words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES + "+")),
        lines=F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != ""),
    )
    n = F.size("words")
    hashed = bound(split, "doc_id", "text", "words", "lines", hashes=F.when(n > WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )))
    suspected = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return bound(
        hashed, "doc_id", "text",
        n_words=n.cast("long"),
        word_chars=(F.length("text") - F.regexp_count("text", F.lit(SPACES))).cast("long"),
        n_symbols=F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=F.when(suspected, _repeated_words(F.col("words"))).otherwise(0).cast("long"),
    )


def _repeated_words(words: Column) -> Column:
    """Words in windows found twice or more: sort the windows, keep those with an equal neighbour, add up their union."""
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("window"), i.alias("at")),
    ))

    def positions(held):
        twice = F.filter(held, lambda x, k: (
            x["window"].eqNullSafe(F.get(held, k - 1)["window"]) | x["window"].eqNullSafe(F.get(held, k + 1)["window"])
        ))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    starts = F.get(F.transform(F.array(windows), positions), F.lit(0))   # binds the sorted array once
    return F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda acc, at: F.struct(at.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, from a few input files where the frame has files."""
    files = sorted(docs.inputFiles())
    if files:
        step = max(1, len(files) // 4)
        few = docs.sparkSession.read.schema(docs.schema).parquet(*files[::step][:4])
        return cut_lineage(few.select("doc_id", "text").limit(rows))
    return cut_lineage(docs.select("doc_id", "text").limit(rows))


def measured_order(docs: DataFrame, rules: dict[str, str] | None = None, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, the highest rejection per second first (ties by name)."""
    rules = rules or RULES
    sample = cut_lineage(counts(_sample(docs, rows)).where(~base_failed()))
    share = sample.agg(*[F.coalesce(F.avg(F.expr(c).cast("double")), F.lit(0.0)).alias(k) for k, c in rules.items()]).first()

    def seconds(condition: str) -> float:
        took = []
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.count_if(F.expr(condition))).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    nothing = seconds("doc_id IS NULL")
    cost = {k: max(seconds(c) - nothing, 1e-4) for k, c in rules.items()}
    return sorted(rules, key=lambda k: (-share[k] / cost[k], k))


def judged(docs: DataFrame, rules: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per document: the counts, base_failed and kept; the text stays for callers that go on with it."""
    rules = rules or RULES
    order = order or measured_order(docs, rules)
    verdict = F.when(base_failed(), False)
    for name in order:
        verdict = verdict.when(F.expr(rules[name]), False)
    return counts(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict.otherwise(True))
