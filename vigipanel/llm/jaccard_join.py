"""Exact Jaccard join of word-shingle sets by a partitioned universe.

Sets of one size band (sizes within a factor 1.25) and those just below it cut
the universe of shingles into the same m segments by hash.  Sets with a Jaccard
similarity of at least ``NUM`` / ``DEN`` differ in at most H elements, so of
H + 1 segments one is the same in both (pigeonhole).  Every non-empty segment is
a key; equal keys make candidates, which are verified on the whole sets.

How much each segment counts is allotted by its cost: an exact one counts 1 and
costs one key, one with its one-deletion neighbourhood counts 2 and costs as many
keys as it has elements, an empty one is no key.  A set is covered once its
segments count H + 1, and a pair is found as soon as one of its two sets is
covered:

* 0: exact segments, which cover all but sets with many empty segments;
* 1: for those, all segments with one-deletion neighbourhoods;
* 2: for those whom that does not cover either, every element is a key (sets with
  a similarity above 0 share one).

Keys of up to ``MANY`` sets give pairs; in larger ones all meet a hub, and a few
more hubs while a key holds several components (``hubs.linked``).  What is left
apart then is not compared pair by pair but joined exactly on the rare elements
of the sets, so no link is lost.  As there are more segments than H + 1, linked
sets agree in several: a set that shares fewer of its keys of a band with any
others, at first or among the keys left apart, has no link there (``needed``).  Before whole sets are compared, the sizes and
one byte per segment are: sets that differ in more segments than the elements in
which they may differ are not linked.
Equal sets are one class from the start; a class counts as one item however
many documents it has.

Edge cases: null, empty or blank texts have an empty set, 0 shingles and are
linked with nothing; fewer than five words are one shingle.  Rows that repeat a
doc_id are compared each by its own text and give one row each.  A row with a
null doc_id takes part; its component is the least doc_id that it reaches, null
if there is none.  An empty table gives an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from vigipanel.llm import tokens as tk
from vigipanel.llm.groups import components
from vigipanel.llm.hubs import linked, once, sharing
from vigipanel.llm.minhash_pairs import _rare_pairs as rare_pairs, confirmed
from vigipanel.session import cut_lineage

NUM, DEN = 80, 100
SHINGLE = 5
MANY = 2
SEEN = 1 << 18                     # places for classes that a task remembers, to give the keys of equal sets once
BROADCAST_IDS = 1_000_000
_SALT = np.uint64(0xD6E8FEB86659FD93)
_ZERO = np.zeros(1, np.int64)


def edges_of_bands(largest: int) -> list[int]:
    """First sizes of the bands up to that of ``largest``, and of the one behind it."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * DEN // NUM + 1)
    return edges + [edges[-1] * DEN // NUM + 1]


def allowed(a: int, b: int) -> int:
    """Elements in which linked sets of sizes a and b can differ, at most; it never falls as a or b grow."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


@lru_cache(maxsize=1 << 14)
def schemes(size: int) -> list[tuple[int, int, int]]:
    """(band, segments, elements that may differ) for a set's own band and the next one."""
    edges = edges_of_bands(size)
    band = len(edges) - 3
    out = []
    for k in (band, band + 1):
        high = edges[k + 1] - 1
        most = allowed(high, high)
        partner = min(high, size * DEN // NUM)
        out.append((k, most + 1 + 2 + most // 16, allowed(size, partner)))
    return out


def banded(keys: np.ndarray, band: int) -> np.ndarray:
    """Keys whose lowest bit tells a set's own band from the next one."""
    return keys >> np.uint64(1) << np.uint64(1) | np.full(1, band % 2, np.uint64)


def segment_keys(elements: np.ndarray, band: int, segments: int):
    """Per non-empty segment its key, and order, starts and sizes of the elements by segment."""
    spread = tk.mix(elements + _SALT)
    # small numbers are sorted by their digits
    place = (spread % np.uint64(segments)).astype(np.uint16 if segments <= 1 << 16 else np.int64)
    order = np.argsort(place, kind="stable")
    held, spread = place[order], spread[order]
    starts = np.concatenate((_ZERO, np.flatnonzero(held[1:] != held[:-1]) + 1))
    sums = np.add.reduceat(spread, starts)
    salt = held[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.full(1, band + 1, np.uint64) * _SALT
    return banded(tk.mix(sums + salt), band), spread, starts, np.diff(starts, append=len(held)), sums, salt


def own_keys(elements: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of ``segment_keys`` and their segments, for sets whose elements need no order."""
    spread = tk.mix(elements + _SALT)
    place = (spread % np.uint64(segments)).astype(np.int64)
    count = np.bincount(place, minlength=segments)
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, place, spread)
    held = np.flatnonzero(count)
    salt = held.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.full(1, band + 1, np.uint64) * _SALT
    return banded(tk.mix(sums[held] + salt), band), held


def class_of(elements: np.ndarray) -> int:
    """A set's identity: 63 bits from all its elements (positive, to tell it from keys at a glance)."""
    total = np.add.reduce(tk.mix(elements ^ _SALT), keepdims=True) + np.uint64(len(elements))
    return int(tk.mix(total)[0] >> np.uint64(1))


def _bytes_of(keys: np.ndarray, held: np.ndarray, segments: int) -> bytes:
    """One byte per segment, the same where the segment is the same."""
    out = np.zeros(segments, np.uint8)
    out[held] = (keys >> np.uint64(56)).astype(np.uint8)
    return out.tobytes()


def _members(batches):
    """Each set's size, class and band; for that band and the next: in how many non-empty segments a linked set agrees (0 or less: not covered), and a byte per segment."""
    for batch in batches:
        out = []
        for elements in tk.shingle_sets(batch["text"], SHINGLE):
            if not len(elements):
                out.append((0, None, None, None, None, None, None))
                continue
            needs, signs, bands = [], [], schemes(len(elements))
            for band, segments, differ in bands:
                keys, held = own_keys(elements, band, segments)
                signs.append(_bytes_of(keys, held, segments))
                needs.append(len(keys) - differ)
            out.append((len(elements), class_of(elements), bands[0][0], *needs, *signs))
        n, items, bands, need, need_next, own, later = zip(*out) if out else ((),) * 7
        # a column of 63-bit integers with nulls must not pass through floats
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "n": np.array(n, np.int64), "item": pd.array(items, dtype="Int64"),
            "band": pd.array(bands, dtype="Int32"), "need": pd.array(need, dtype="Int32"), "need_next": pd.array(need_next, dtype="Int32"), "own": list(own), "next": list(later),
        })


def _first_keys(batches):
    """Level 0: (key, item) per non-empty segment; equal sets of a task once, as far as it remembers them."""
    seen = np.full(SEEN, -1, np.int64)
    for batch in batches:
        keys, items, held = [], [], 0
        for elements in tk.shingle_sets(batch["text"], SHINGLE):
            name = class_of(elements) if len(elements) else None
            if name is None or seen[name % SEEN] == name:
                continue
            seen[name % SEEN] = name
            own = [tk.signed(own_keys(elements, band, segments)[0]) for band, segments, _ in schemes(len(elements))]
            keys.extend(own)
            items.append((name, sum(map(len, own))))
            held += items[-1][1]
            if held > 200_000:
                yield _key_frame(keys, items)
                keys, items, held = [], [], 0
        if items:
            yield _key_frame(keys, items)


def _key_frame(keys, items) -> pd.DataFrame:
    names, counts = np.array([i for i, _ in items]), np.array([c for _, c in items])
    return pd.DataFrame({"key": np.concatenate(keys), "item": np.repeat(names, counts)})


def _further_keys(batches):
    """Levels 1 and 2 for sets that their exact segments do not cover: (key, item)."""
    for batch in batches:
        for name, text in zip(batch["item"], batch["text"]):
            elements = tk.shingles(text, SHINGLE)
            found = []
            for band, segments, differ in schemes(len(elements)):
                keys, spread, starts, sizes, sums, salt = segment_keys(elements, band, segments)
                if len(keys) >= differ + 1:
                    continue
                out = []
                tag = np.full(1, 1, np.uint64) * np.uint64(0xA24BAED4963EE407)
                out.append(tk.mix(keys ^ tag))
                several = sizes > 1
                without = np.repeat(sums, sizes) - spread
                out.append(tk.mix(tk.mix(without + np.repeat(salt, sizes))[np.repeat(several, sizes)] ^ tag))
                if len(keys) + several.sum() < differ + 1:
                    out.append(tk.mix(spread + np.full(1, 3, np.uint64) * _SALT))
                found.append(banded(np.concatenate(out), band))
            if found:
                keys = tk.signed(np.unique(np.concatenate(found)))
                yield pd.DataFrame({"key": keys, "item": name})


def _sets(batches):
    """(item, elements) from the texts that were fetched for an item; another text of the same row name is left out."""
    for batch in batches:
        sets = list(tk.shingle_sets(batch["text"], SHINGLE))
        good = [len(x) > 0 and class_of(x) == item for x, item in zip(sets, batch["item"])]
        yield pd.DataFrame({"item": batch["item"][good], "elements": [tk.signed(x) for x, fits in zip(sets, good) if fits]})


@F.pandas_udf(IntegerType())
def _differing(one: pd.Series, two: pd.Series) -> pd.Series:
    """In how many segments two sets differ, at least."""
    return pd.Series([np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)) for x, y in zip(one, two)], dtype="int32")


def possible(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` without those whose sizes or segments rule a link out; ``signs(item, n, band, own, next)``."""
    one, two = (signs.select(F.col("item").alias(c), F.struct("n", "band", "own", "next").alias(f"s{c}")) for c in "ab")
    met = pairs.join(one, "a").join(two, "b").where(
        (DEN * F.least("sa.n", "sb.n") >= NUM * F.greatest("sa.n", "sb.n")) & (F.abs(F.col("sa.band") - F.col("sb.band")) <= 1))
    band = F.greatest("sa.band", "sb.band")
    sign = [F.when(F.col(f"s{c}.band") == band, F.col(f"s{c}.own")).otherwise(F.col(f"s{c}.next")) for c in "ab"]
    return met.where(_differing(*sign) <= F.floor((DEN - NUM) * (F.col("sa.n") + F.col("sb.n")) / (DEN + NUM))).select("a", "b")


def needed(shared: DataFrame, needs: DataFrame) -> DataFrame:
    """(item, bit) of the sets that share enough keys of a band to be linked there: ``shared(item, bit, n)``, ``needs(item, bit, need)``."""
    held = shared.groupBy("item", "bit").agg(F.sum("n").alias("n"))
    return held.join(needs, ["item", "bit"]).where("n >= need").select("item", "bit")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, item), classes (item, low, copies) and the linked pairs of classes (a, b) that connect all linked ones."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    members = cut_lineage(own.mapInPandas(_members, "doc_id long, row long, n long, item long, band int, need int, need_next int, own binary, next binary"))
    items = members.where("item IS NOT NULL").groupBy("item").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "n", "band", "need", "need_next", "own", "next")).alias("m"))
    items = cut_lineage(items.select("item", "low", "copies", "m.*"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = cut_lineage(wanted.select("item", "row"))
        hint = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
        return own.select("row", "text").join(hint, "row").select("item", "text")

    met = cut_lineage(sharing(own.select("text").mapInPandas(_first_keys, "key long, item long"), MANY).union(
        sharing(texts_of(items.where("need <= 0 OR need_next <= 0")).mapInPandas(_further_keys, "key long, item long"), MANY)))
    needs = items.select("item", F.inline(F.array(
        F.struct((F.col("band") % 2).alias("bit"), F.col("need")), F.struct((1 - F.col("band") % 2).alias("bit"), F.col("need_next").alias("need")))))
    pairs, many = met.where("NOT many"), met.where("many").select(F.col("a").alias("key"), F.col("b").alias("item"), "bit")
    shared = many.select("item", "bit", F.lit(1).cast("long").alias("n")).union(pairs.select(F.explode(F.array("a", "b")).alias("item"), "bit", "n"))
    fit = cut_lineage(needed(shared, needs))
    fits = {c: fit.select(F.col("item").alias(c), "bit") for c in "ab"}
    pairs = cut_lineage(pairs.join(fits["a"], ["a", "bit"], "left_semi").join(fits["b"], ["b", "bit"], "left_semi").select("a", "b").distinct())
    many, stands = once(cut_lineage(many.join(fit, ["item", "bit"], "left_semi").select("key", "item")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("item")).union(many.select("item")).distinct()
    signs = cut_lineage(items.join(wanted, "item").select("item", "row", "n", "band", "own", "next"))
    sets = cut_lineage(texts_of(signs).mapInPandas(_sets, "item long, elements array<long>").dropDuplicates(["item"]))

    def verified(found: DataFrame) -> DataFrame:
        return confirmed(cut_lineage(possible(found, signs)), sets)

    links, left = linked(pairs, many, verified)
    if not left.isEmpty():
        fit = needed(left.join(stands, "key").select("item", F.col("key").bitwiseAND(1).cast("int").alias("bit"), "n"), needs)
        open_ = cut_lineage(left.select("item", "root").distinct().join(fit.select("item").distinct(), "item"))
        links = links.union(verified(rare_pairs(open_, sets)))
    return members, items, links


def joined(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id of the component)."""
    members, items, links = classes(docs)
    roots = components(links).withColumnRenamed("node", "item")
    grouped = items.join(roots, "item", "left").where("copies > 1 OR root IS NOT NULL").select("item", "low", F.coalesce("root", "item").alias("root"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(grouped.join(least, "root").select("item", F.struct("component_id").alias("group")))
    out = members.select("doc_id", F.col("n").alias("n_shingles"), "item").join(named, "item", "left")
    component = F.when(F.col("group").isNotNull(), F.col("group.component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
