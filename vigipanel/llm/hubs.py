"""Items that share keys, linked through hubs: the work grows with the rows, not with the pairs of a key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigipanel.llm.groups import components
from vigipanel.session import cut_lineage

ROUNDS = 3


BUFFER = 100_000


def sharing(rows: DataFrame, limit: int = 2, probes: bool = False) -> DataFrame:
    """Which items of ``rows(key long, item long)`` share a key.

    Keys with 2 to ``limit`` distinct items give their pairs as (a < b, false);
    keys with more give each item once, as (key, item, true).  ``bit`` is the
    lowest bit of the key and n how many keys of a task gave the row.  With
    ``probes`` an odd item is a probe, and a key of probes only gives nothing.
    Each task reads its rows in key order, probes last, and holds ``BUFFER`` rows
    and ``limit`` items more or less, however many a key has.
    """

    def run(batches):
        key = item = np.zeros(0, np.int64)         # rows of the last key, while there are few
        over, useful, last = None, True, None      # the last key if it has more than limit items, and whether it counts; the last row
        for k, i in _buffered(batches):
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            new[0] = (k[0], i[0]) != last
            last = (k[-1], i[-1])
            k, i = k[new], i[new]
            more = int(np.searchsorted(k, over, "right")) if over is not None else 0
            if more and useful:
                yield _crowd(k[:more], i[:more])
            k, i = np.concatenate((key, k[more:])), np.concatenate((item, i[more:]))
            if len(k):
                cut = int(np.searchsorted(k, k[-1]))
                yield _met(k[:cut], i[:cut], limit, probes)
                key, item, over = k[cut:], i[cut:], None
                if len(key) > limit:
                    useful = not probes or item[0] & 1 == 0
                    if useful:
                        yield _crowd(key, item)
                    key, item, over = key[:0], item[:0], key[0]
        yield _met(key, item, limit, probes)

    order = ["key", F.col("item").bitwiseAND(F.lit(1)), "item"] if probes else ["key", "item"]
    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(run, "a long, b long, many boolean, bit int, n long")


def _buffered(batches):
    """The rows of several batches as (keys, items)."""
    keys, items, size = [], [], 0
    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        items.append(batch.column("item").to_numpy())
        size += len(batch)
        if size >= BUFFER:
            yield np.concatenate(keys), np.concatenate(items)
            keys, items, size = [], [], 0
    if size:
        yield np.concatenate(keys), np.concatenate(items)


def _found(a: np.ndarray, b: np.ndarray, many: np.ndarray, bit: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, many, bit.astype(np.int32), n.astype(np.int64))], names=["a", "b", "many", "bit", "n"])


def _crowd(key: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
    return _found(key, item, np.ones(len(key), bool), key & 1, np.ones(len(key)))


def _met(key: np.ndarray, item: np.ndarray, limit: int, probes: bool) -> pa.RecordBatch:
    """Whole keys, each row once."""
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)              # most keys have one item
    shared[1:] |= same
    shared[:-1] |= same
    key, item = key[shared], item[shared]
    start = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    if probes:
        useful = item[start] & 1 == 0
        held = np.repeat(useful, size)
        key, item, size = key[held], item[held], size[useful]
    many = np.repeat(size > limit, size)
    k, i = key[~many], item[~many]
    pairs = []
    for d in range(1, limit):
        at = np.flatnonzero(k[d:] == k[:-d])
        pairs.append(np.stack((np.minimum(i[at], i[at + d]), np.maximum(i[at], i[at + d]), k[at] & 1), 1))
    pairs, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
    crowd = int(many.sum())
    return _found(
        np.concatenate((key[many], pairs[:, 0])), np.concatenate((item[many], pairs[:, 1])), np.arange(crowd + len(n)) < crowd,
        np.concatenate((key[many] & 1, pairs[:, 2])), np.concatenate((np.ones(crowd), n)),
    )


def once(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``many(key, item)`` without the keys that hold the same items as another, and (key, n) how many each stands for."""
    held = many.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("y"),
    ).groupBy("c", "x", "y", F.col("key").bitwiseAND(1).alias("bit")).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    held = cut_lineage(held.where("c > 1").select("key", "n"))
    return cut_lineage(many.join(held, "key", "left_semi")), held


def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, item, w, root) of the keys of ``rows(key, item, w)`` that hold several components."""
    rows = rows.join(roots.withColumnRenamed("node", "item"), "item", "left").select("key", "item", "w", F.coalesce("root", "item").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return cut_lineage(rows.join(several, "key"))


def linked(pairs: DataFrame, many: DataFrame, verified, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) among ``pairs(a < b)`` and along the hubs of ``many(key, item)``, and what may still be linked.

    In each round all items of a key meet its hub, the item with the most keys,
    unless they are in its component already; the hub then leaves the key.  A
    round that leaves more than half of the rows open is the last one.
    The second frame is (key, item, w, root) of the keys that still hold several
    components: two items that could be linked and are not share one of them.
    """
    weight = many.groupBy("item").agg(F.count(F.lit(1)).alias("w"))
    links, open_ = None, cut_lineage(many.join(weight, "item").select("key", "item", "w", F.col("item").alias("root")))
    size = open_.count()
    for turn in range(rounds):
        hubs = open_.groupBy("key").agg(F.max_by(F.struct("item", "root"), F.struct("w", "item")).alias("hub"))
        star = cut_lineage(open_.join(hubs, "key"))
        met = star.where("root <> hub.root").select(F.least("item", "hub.item").alias("a"), F.greatest("item", "hub.item").alias("b"))
        found = verified((met if turn else met.union(pairs)).distinct())
        links = found if links is None else cut_lineage(links.union(found))
        open_ = apart(star.where("item <> hub.item").select("key", "item", "w"), components(links))
        size, before = open_.count(), size
        if 2 * size > before or not size:
            break
    return links, open_
