"""Mixing sources to target weights by temperature.

The weight of a source is its share of all tokens raised to an exponent and
normalised: 1 keeps the shares, 0 makes all sources equal.  The exponent is
found by repeated section with sums over the source table: the largest one that
reaches the target entropy, raised until no source is repeated more often than
allowed.  Weights become a token budget per source, which is realised by
permutations: whole epochs over a source's documents, then a last one in an
order of blocks drawn by hash.  Blocks before the edge of the budget go in
whole; only the block on the edge is cut, document by document.

A source is spread over ``BLOCKS`` blocks, so a hot source is joined by (source,
block) and no window spans more than the blocks of a source or one block.

Edge cases: a null source is a source of its own.  Documents without a word
(null or blank texts) cost nothing and are never chosen.  Repeated rows are
documents of their own.  A table without a word gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigipanel.session import cut_lineage

BLOCKS = 1024
SECTIONS, ROUNDS = 16, 8
LEAST_ENTROPY = 0.95           # of the entropy of equal weights
MOST_REPEATS = 4.0


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _section(sources: DataFrame, total: int, holds) -> float:
    """The largest exponent in [0, 1] at which ``holds(z, slope, steepest, exponent)``, or 0."""
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.lit(float(total))
    for turn in range(ROUNDS):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        sums = sources.agg(*[c for k, e in enumerate(grid) for c in (
            F.sum(F.pow(share, F.lit(e))).alias(f"z{k}"), F.sum(F.pow(share, F.lit(e)) * F.log(share)).alias(f"s{k}"),
            F.max(F.pow(share, F.lit(e - 1.0))).alias(f"m{k}"),
        )]).first()
        good = [k for k, e in enumerate(grid) if holds(sums[f"z{k}"], sums[f"s{k}"], sums[f"m{k}"], e)]
        if turn == 0 and not good:
            return 0.0
        best = max(good) if good else 0
        if best == SECTIONS:
            return high
        low, high = grid[best], grid[best + 1]
    return low


def exponent(sources: DataFrame, budget_share: float = 1.0, entropy: float = LEAST_ENTROPY, repeats: float = MOST_REPEATS) -> float:
    """The exponent for ``sources(source, tokens)``; every source has tokens."""
    count, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not count or count == 1:
        return 1.0
    wanted = entropy * math.log(count)
    flat = _section(sources, total, lambda z, s, m, e: math.log(z) - e * s / z >= wanted - 1e-12)
    # repetition falls as the exponent grows, so look from the other end
    def too_often(z, s, m, e):
        return budget_share * m / z > repeats * (1 + 1e-9)

    if budget_share > repeats:
        return 1.0
    least = _section(sources, total, too_often)
    return max(flat, least + (SECTIONS ** -ROUNDS if least > 0 else 0.0))


def mixed(docs: DataFrame, budget_share: float = 1.0, entropy: float = LEAST_ENTROPY, repeats: float = MOST_REPEATS) -> DataFrame:
    """One row per chosen row of ``docs(doc_id, source, text)``: doc_id, source, n_tokens, block, copies.

    ``budget_share`` is the budget in tokens over the tokens of all documents.
    """
    rows = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(BLOCKS)))
    rows = cut_lineage(rows).where("n_tokens > 0")          # three slim passes instead of three over the texts
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    sources = cut_lineage(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    power = exponent(sources, budget_share, entropy, repeats)
    weight = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(power))
    z = sources.agg(F.sum(weight)).first()[0] or 1.0
    quota = sources.select(
        F.col("source").alias("quota_source"), F.floor(weight / F.lit(z) * F.lit(budget_share * total)).cast("long").alias("quota"), F.col("tokens").alias("size"),
    ).select("quota_source", F.floor(F.col("quota") / F.col("size")).alias("epochs"), F.expr("quota % size").alias("rest"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit("order")), "block").rowsBetween(Window.unboundedPreceding, -1)
    plan = blocks.join(quota, F.col("source").eqNullSafe(F.col("quota_source"))).select(
        F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "epochs",
        (F.col("rest") - F.coalesce(F.sum("tokens").over(order), F.lit(0))).alias("room"), "tokens",
    )
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit("inside")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("block") == F.col("plan_block")))
    held = held.withColumn("used", F.sum("n_tokens").over(inside))
    return held.select(
        "doc_id", "source", "n_tokens", "block", (F.col("epochs") + (F.col("used") <= F.col("room")).cast("long")).alias("copies"),
    ).where("copies > 0")
