"""Rows that meet on a key, and connected components, without large groups in one place."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigipanel.session import cut_lineage


def meeting(rows: DataFrame, limit: int) -> DataFrame:
    """Which items of ``rows(key long, item long)`` share a key.

    One shuffle by key; each task then reads its rows in key order and holds one
    key at a time.  Keys with 2 to ``limit`` distinct items give all their pairs
    (at most limit / 2 per row) as (a < b, false); keys with more give one row
    per item as (key, item, true), to be treated by the caller.
    """

    def run(batches):
        key = item = np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate((key, batch["key"].to_numpy()))
            item = np.concatenate((item, batch["item"].to_numpy()))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0      # the last key may go on
            if cut:
                yield _meet(key[:cut], item[:cut], limit)
                key, item = key[cut:], item[cut:]
        if len(key):
            yield _meet(key, item, limit)

    ordered = rows.repartition("key").sortWithinPartitions("key", "item")
    return ordered.mapInPandas(run, "a long, b long, many boolean").distinct()


def _meet(key: np.ndarray, item: np.ndarray, limit: int) -> pd.DataFrame:
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
    key, item = key[new], item[new]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    each = np.repeat(size, size)
    many = each > limit
    out = [np.stack((key[many], item[many]), 1)]
    few = (each > 1) & ~many
    key, item = key[few], item[few]
    pairs = [np.stack((item[:-d], item[d:]), 1)[key[:-d] == key[d:]] for d in range(1, int(size[size <= limit].max(initial=1)))]
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    rows = np.concatenate((out[0], pairs))
    return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "many": np.arange(len(rows)) < many.sum()})


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int = 500):
    """Smaller Arrow batches for what is computed inside: a batch of text pairs weighs more than one of numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the texts of both ends from ``texts(item, text)``."""
    one = texts.select(F.col("item").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("item").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    a, b = (roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    ).select(*pairs.columns)


def linked(pairs: DataFrame, many: DataFrame, verified, rounds: int = 2) -> DataFrame:
    """Verified links that join all items that links connect, without verifying every pair.

    ``pairs(a < b)`` are candidates, ``many(key, item)`` are the items of frequent
    keys, any two of which are candidates as well; ``verified(pairs)`` keeps the
    true links.  In each round an item meets one partner only, the one with the
    most candidates itself, which tends to be what a group was copied from.
    Afterwards the candidates whose ends are still in different components are
    verified, until none is left.
    """
    sizes = many.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = cut_lineage(
        pairs.select(F.inline(F.array(*[F.struct(F.col(c).alias("item"), F.lit(1).cast("long").alias("n")) for c in "ab"])))
        .union(many.join(sizes, "key").select("item", "n")).groupBy("item").agg(F.sum("n").alias("w"))
    )
    hubs = many.join(weight, "item").groupBy("key").agg(F.max_by("item", F.struct("w", "item")).alias("hub"))
    star = many.join(hubs, "key").where("item <> hub").select(F.least("item", "hub").alias("a"), F.greatest("item", "hub").alias("b"))
    weights = {c: weight.select(F.col("item").alias(c), F.col("w").alias(f"w{c}")) for c in "ab"}
    untried = cut_lineage(pairs.union(star).distinct().join(weights["a"], "a").join(weights["b"], "b"))
    links, roots = pairs.select("a", "b").limit(0), None
    for _ in range(rounds):
        ends = untried.select(F.inline(F.array(
            F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.col("wb").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.col("wa").alias("w")),
        )))
        picked = ends.groupBy("u").agg(F.max_by("v", F.struct("w", "v")).alias("v"))
        picked = cut_lineage(picked.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        links = cut_lineage(links.union(verified(picked)))
        roots = components(links)
        untried = cut_lineage(_apart(untried.join(picked, ["a", "b"], "left_anti"), roots))
        if untried.isEmpty():
            break
    links = cut_lineage(links.union(verified(untried.select("a", "b"))))
    left = many.join(components(links).withColumnRenamed("node", "item"), "item", "left").select("key", "item", F.coalesce("root", "item").alias("root"))
    several = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = cut_lineage(left.join(several, "key"))
    one = left.select("key", F.col("item").alias("a"), F.col("root").alias("ra"))
    two = left.select("key", F.col("item").alias("b"), F.col("root").alias("rb"))
    rest = one.join(two, "key").where("ra < rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.union(verified(rest))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the least node of the component.

    Alternating large-star and small-star steps: each node links its neighbours
    to its least neighbour, until only stars are left.  All state is an edge
    table; one yes or no per turn reaches the driver.
    """
    now = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        ends = now.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(int(c == "b")).alias("below")) for c in "ab"])))
        ends = ends.groupBy("node").agg(F.sum("below").alias("links"), F.min("below").alias("top"))
        # done when every node below links to one node, which is below none
        if ends.where("links > 1 OR (links = 1 AND top = 0)").isEmpty():
            break
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).union(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(
            F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b"))))
        ).where("a <> b").distinct()
        now = cut_lineage(small)
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
