"""Near-duplicate documents by MinHash with tensored banding, verified on whole sets.

A document is its set of word shingles; equal sets are one item from the start.
Two collections of ``HALVES`` half-keys each hold ``HASHES`` min-hashes per
half-key, and every pair of a half-key of one and a half-key of the other is a
table key: HALVES squared tables of 2 * HASHES min-hashes from 2 * HALVES *
HASHES min-hashes, the square root of what separate tables would need.  Two sets
of similarity s share a key with probability (1 - (1 - s**HASHES)**HALVES)**2,
0.9995 at 0.8 (see ``chance``).

A half-key that one item alone has is dropped, and so are the items that share
none of one collection.  Two items that share a half-key of either collection
share a table key; table keys are not formed.  All items of a half-key meet its
hub first, the one with the most shared half-keys, which then leaves it; up to
``ROUNDS`` hubs take their turn while a half-key holds several components and
each round closes more than half of what is open.  What is left then is not
compared pair by pair:
the items still apart are joined exactly, on the rare elements of their sets (of
n elements ordered by frequency two linked sets share one of the first
n - 0.8 n + 1, near enough to the front that the rest can still suffice), where
an item of the component that holds most of an element's items never meets its
own.  All links are confirmed by counting common elements of whole sets.

Edge cases: null, empty and blank texts have an empty set, no link, and are kept;
a text of fewer than four words is one shingle.  Rows that repeat a doc_id are
compared each by its own text.  A row with a null doc_id takes part; its
component is the least doc_id it reaches, null if there is none, and it is kept
only then.  Texts of any length are hashed in slices.  An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigipanel.llm import tokens as tk
from vigipanel.llm.groups import components
from vigipanel.session import cut_lineage

NUM, DEN = 80, 100
SHINGLE = 4
HASHES, HALVES = 4, 16
ROUNDS = 3
_SLICE = 1024
_draw = np.random.default_rng(7)
_TIMES = _draw.integers(1, 1 << 63, 2 * HALVES * HASHES, dtype=np.uint64) | np.uint64(1)
_FLIP = _draw.integers(1, 1 << 63, 2 * HALVES * HASHES, dtype=np.uint64)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def chance(similarity: float) -> float:
    """The probability that two sets of this similarity share a key."""
    return (1 - (1 - similarity ** HASHES) ** HALVES) ** 2


def half_keys(elements: np.ndarray) -> np.ndarray:
    """The half-keys of both collections, one after the other."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(elements), _SLICE):
        part = elements[k:k + _SLICE]
        np.minimum(least, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    keys = np.arange(1, 2 * HALVES + 1, dtype=np.uint64) * _SALT
    for column in tk.mix(least).reshape(2 * HALVES, HASHES).T:
        keys = tk.mix(keys ^ column)
    return keys


def item_of(elements: np.ndarray) -> int:
    """A name of the set: 63 bits from all its elements."""
    total = np.add.reduce(tk.mix(elements ^ _SALT), keepdims=True) + np.uint64(len(elements))
    return int(tk.mix(total)[0] >> np.uint64(1))


def _members(batches):
    for batch in batches:
        sizes, items, halves = [], [], []
        for elements in tk.shingle_sets(batch["text"], SHINGLE):
            sizes.append(len(elements))
            items.append(item_of(elements) if len(elements) else None)
            halves.append(tk.signed(half_keys(elements)) if len(elements) else None)
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "n": np.array(sizes, np.int64), "item": pd.array(items, dtype="Int64"), "halves": halves,
        })


def _sets(batches):
    """(item, elements) from the texts that were fetched for an item; another text of the same row name is left out."""
    for batch in batches:
        sets = list(tk.shingle_sets(batch["text"], SHINGLE))
        own = [len(x) > 0 and item_of(x) == item for x, item in zip(sets, batch["item"])]
        yield pd.DataFrame({"item": batch["item"][own], "elements": [tk.signed(x) for x, good in zip(sets, own) if good]})


def _alike(a: str | Column, b: str | Column) -> Column:
    """Sizes that linked sets can have."""
    return (DEN * F.least(a, b) >= NUM * F.greatest(a, b))


def _both(rows: DataFrame) -> DataFrame:
    """(item, w) of the items that ``rows(item, second)`` holds with half-keys of both collections, and how many."""
    held = rows.groupBy("item").agg(F.count(F.lit(1)).alias("w"), F.min("second").alias("low"), F.max("second").alias("high"))
    return held.where("high AND NOT low").select("item", "w")


def shared_halves(items: DataFrame) -> DataFrame:
    """(half, item, second, w): the half-keys of ``items(item, halves)`` that several have, of items that share some of both collections."""
    halves = items.select("item", F.posexplode("halves").alias("at", "half")).select("half", "item", (F.col("at") >= HALVES).alias("second"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    rows = cut_lineage(halves.join(shared, "half"))
    return cut_lineage(rows.join(_both(rows), "item").select("half", "item", "second", "w"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones among ``pairs(a, b)``, by whole sets."""
    one, two = (sets.select(F.col("item").alias(c), F.col("elements").alias(f"set_{c}")) for c in "ab")
    n, m, both = F.size("set_a"), F.size("set_b"), F.size(F.array_intersect("set_a", "set_b"))
    return cut_lineage(pairs.join(one, "a").join(two, "b").where(_alike(n, m)).where(DEN * both >= NUM * (n + m - both)).select("a", "b"))


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "item"), "item", "left").withColumn("root", F.coalesce("root", "item"))


def _apart(halves: DataFrame, roots: DataFrame) -> DataFrame:
    """(half, item, second, w, root) of the half-keys that hold several components, as far as an item has some of both collections."""
    rows = _with_roots(halves, roots)
    several = rows.groupBy("half").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("half")
    rows = cut_lineage(rows.join(several, "half").select("half", "item", "second", "w", "root"))
    return cut_lineage(rows.join(_both(rows).select("item"), "item", "left_semi"))


def linked(halves: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that connect all items which links among those that share a half-key of either collection connect."""
    links, open_, size = None, halves.withColumn("root", F.col("item")), halves.count()
    for _ in range(ROUNDS):
        hubs = open_.groupBy("half").agg(F.max_by(F.struct("item", "root"), F.struct("w", "item")).alias("hub"))
        star = cut_lineage(open_.join(hubs, "half"))
        met = star.where("root <> hub.root").select(F.least("item", "hub.item").alias("a"), F.greatest("item", "hub.item").alias("b")).distinct()
        found = confirmed(met, sets)
        links = found if links is None else cut_lineage(links.union(found))
        open_ = _apart(star.where("item <> hub.item").select("half", "item", "second", "w"), components(links))
        size, before = open_.count(), size
        if not size:
            return links
        if 2 * size > before:
            break
    items = cut_lineage(open_.select("item", "root").distinct())
    return links.union(confirmed(_rare_pairs(items, sets), sets))


def _rare_pairs(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a < b) of ``items(item, root)`` with different roots that can be linked, exact: no such link is left out."""
    own = sets.join(items, "item")
    element = own.select("item", F.explode("elements").alias("element"))
    often = element.groupBy("element").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # elements of one item alone come first in the order, and match nothing
    order = element.join(often, "element").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("f", "element"))).alias("order"))     # a set's elements at most
    placed = order.join(own.select("item", "root", F.size("elements").alias("n")), "item").select(
        "item", "root", "n", F.posexplode("order").alias("k", "e"), (F.col("n") - F.size("order")).alias("alone"),
    ).select("item", "root", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("e.element").alias("element"))
    placed = cut_lineage(placed.where(f"{DEN} * at <= {DEN - NUM} * n"))
    main = placed.groupBy("element", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("element").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("element", "main")
    placed = cut_lineage(placed.join(main, "element"))
    one = placed.where("root <> main").select("element", F.col("item").alias("i"), F.col("root").alias("ri"), F.col("n").alias("ni"), F.col("at").alias("pi"))
    two = placed.select("element", F.col("item").alias("j"), F.col("root").alias("rj"), F.col("n").alias("nj"), F.col("at").alias("pj"))
    met = one.join(two, "element").where(
        (F.col("ri") != F.col("rj")) & _alike("ni", "nj") & ((DEN + NUM) * F.least(F.col("ni") - F.col("pi"), F.col("nj") - F.col("pj")) >= NUM * (F.col("ni") + F.col("nj")))
    )
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id of the component), kept."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    members = cut_lineage(own.mapInPandas(_members, "doc_id long, row long, n long, item long, halves array<long>"))
    items = cut_lineage(members.where("item IS NOT NULL").groupBy("item").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "halves")).alias("m")).select("item", "low", "copies", "m.row", "m.halves"))
    halves = shared_halves(items)
    needed = halves.select("item").distinct()
    texts = own.select("row", "text").join(items.select("item", "row").join(needed, "item"), "row").select("item", "text")
    sets = cut_lineage(texts.mapInPandas(_sets, "item long, elements array<long>").dropDuplicates(["item"]))
    roots = components(linked(halves, sets)).withColumnRenamed("node", "item")
    grouped = items.join(roots, "item", "left").where("copies > 1 OR root IS NOT NULL").select("item", "low", F.coalesce("root", "item").alias("root"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(grouped.join(least, "root").select("item", F.struct("component_id").alias("group")))
    out = members.select("doc_id", F.col("n").alias("n_shingles"), "item").join(named, "item", "left")
    component = F.when(F.col("group").isNotNull(), F.col("group.component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
