"""URL rules: host-suffix and path-prefix expressions, joined on short digests.

Every URL is expanded into the expressions that could be a rule: each suffix of
its host at a dot, with each prefix of its path, limited to the label counts and
path lengths that occur among the rules.  Expressions and rules meet by an
equality join on the first ``SHORT`` hex digits of their SHA-256; the full
digest is compared afterwards.  Of all rules that fit, the longest wins (host
and path together), then the longer host, then ``block``.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule.  Repeated rows each get their verdict.  Without rules every URL
gets the default.  Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHORT = 8
BROADCAST_RULES = 200_000     # a rule row is under 300 bytes, so under 60 MB
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages(page_id, url)`` and ``rules(action, host, path)`` to one verdict per row of pages.

    Returns page_id, host, path, rule (host and path of the winning rule; else
    null) and verdict.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(
        "action", F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"),
    ).dropDuplicates(["action", "rule"])
    shape = rules.agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("labels")).alias("labels"),
        F.sort_array(F.collect_set("path_length")).alias("lengths"),
    ).first()      # lengths that occur: at most as many as the longest rule has characters
    rules = rules.withColumn("short", F.substring("rule_digest", 1, SHORT))
    if shape["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    def among(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<int>")

    distinct = urls.where(F.col("host") != "").select("host", "path").distinct()
    expressions = (
        distinct.withColumn("parts", F.split("host", r"\."))
        .withColumn("labels", F.explode(F.filter(among(shape["labels"]), lambda k: k <= F.size("parts"))))
        .withColumn("suffix", F.concat_ws(".", F.slice("parts", F.size("parts") - F.col("labels") + 1, F.col("labels"))))
        .withColumn("length", F.explode(F.filter(among(shape["lengths"]), lambda k: k <= F.length("path"))))
        .select("host", "path", _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("length"))).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    fitting = expressions.join(rules, "short").where(F.col("digest") == F.col("rule_digest"))
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct(
            F.length("rule").alias("length"), F.length("rule_host").alias("host_length"),
            (F.col("action") == "block").alias("blocks"), "rule", "action",
        )).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
