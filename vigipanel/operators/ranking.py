"""Ordered totals, ranks, positions and quantiles without one task per group.

A plain window sends a whole group to one task.  Here the rows are cut into
ranges of about equal size first, at split points chosen by a hash of the row:
they do not depend on partitioning, so a recomputed task finds the same ones.
Every range is ordered alone, and the totals of the ranges before it in its
group are added.  The result is exact; the split points only decide how the
work is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigipanel.operators.joins import same_groups
from vigipanel.session import cut_lineage

SPLITS = 4096          # split points of one call, over all groups together, or more:
RANGE_ROWS = 1_000_000  # a range gets about as many rows at most
BROADCAST_SPLITS = 100_000


def _split_points(work: DataFrame, keys: list[str], rows: int, splits: int) -> DataFrame:
    """Sorted split keys per group; about ``splits`` in all."""
    every = max(1, rows // splits)
    chosen = work.where(F.pmod(F.xxhash64(*keys, "_k"), F.lit(every)) == 0)
    return chosen.groupBy(*keys).agg(F.array_sort(F.collect_list("_k")).alias("_cuts"))


def _range_number(splits: int):
    """How many split points lie below the key: a binary search in the array, with room for four times ``splits``."""
    cuts, key = F.col("_cuts"), F.col("_k")
    found = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range((4 * splits).bit_length()))]),
        F.lit(0),
        lambda low, s: F.when(F.get(cuts, low + s - 1) < key, low + s).otherwise(low),
    )
    return F.coalesce(found, F.lit(0))


def running_totals(df: DataFrame, groups: list[str], order: list[str],
                   sums: dict[str, str], splits: int = SPLITS) -> DataFrame:
    """Adds, per ``{new: source}``, the total of ``source`` over rows before this one.

    ``order`` must be unique inside a group (aggregate equal keys first).  The
    input is read several times (split points, range totals, rows), so it is
    checkpointed once: plans stay short however operators are combined.
    """
    groups = list(groups)
    keys = groups or ["_all"]
    work = df if groups else df.withColumn("_all", F.lit(0))
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    work = cut_lineage(work.withColumn("_k", key))
    rows = work.count()
    splits = max(splits, rows // RANGE_ROWS)
    points = _split_points(work, keys, rows, splits)
    ranged = (
        same_groups(work, F.broadcast(points) if splits <= BROADCAST_SPLITS else points, keys, "left")
        .withColumn("_range", _range_number(splits))
        .drop("_cuts")
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(*[F.sum(source).alias(f"_t_{new}") for new, source in sums.items()])
        .select(
            *keys, "_range",
            *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_range").orderBy("_k")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for new, source in sums.items():
        ranged = ranged.withColumn(f"_i_{new}", F.coalesce(F.sum(source).over(inside), F.lit(0)))
    result = same_groups(ranged, offsets, [*keys, "_range"])
    for new in sums:
        result = result.withColumn(new, F.col(f"_o_{new}") + F.col(f"_i_{new}"))
    drop = ["_k", "_range", *[f"_{p}_{n}" for p in "oi" for n in sums]]
    return result.drop(*drop, *([] if groups else ["_all"]))


def row_positions(df: DataFrame, groups: list[str], order: list[str],
                  name: str = "position") -> DataFrame:
    """1-based position in the group; ``order`` must be unique in it."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), groups, order, {"_before": "_one"})
    return counted.withColumn(name, F.col("_before") + 1).drop("_before", "_one")


def average_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row per distinct value: ``rank`` (mean rank of ties) and ``ties``."""
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_totals(counts, groups, [value], {"_below": "ties"})
    return ranked.select(
        *groups, value, "ties", (F.col("_below") + (F.col("ties") + 1) / 2).alias("rank")
    )


def exact_quantiles(df: DataFrame, groups: list[str], value: str,
                    probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, nulls left out."""
    groups = list(groups)
    keys = groups or ["_all"]
    base = (df if groups else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull())
    counts = base.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(counts, keys, [value], {"_b": "_c"})
    sizes = ranked.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = same_groups(ranked, sizes, keys)
    aggs = []
    for name, p in probabilities.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        for side, at in (("l", F.floor(h)), ("u", F.ceil(h))):
            hit = (F.col("_b") <= at) & (at < F.col("_b") + F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
    out = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    columns = []
    for name, p in probabilities.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_l_{name}"), F.col(f"_u_{name}")
        columns.append((low + (high - low) * (h - F.floor(h))).alias(name))
    return out.select(*groups, *columns)
