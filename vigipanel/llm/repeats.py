"""Exact repeats of a minimum length by threshold-bounded interval expansion.

Every string of ``length`` bytes that starts at two places holds the same
anchor: of its grams of ``GRAM`` bytes the one with the least hash (the last, of
equals).  Each place belongs to one anchor, so each anchor stands for a run of
starting places and the stretch of bytes they cover.  Only anchors that occur
again anywhere go on, and of equal stretches under one anchor only one does.

Stretches that share an anchor are sorted out together: starting from the last
bytes of a string, intervals of equal strings are extended backwards, as with a
Burrows-Wheeler transform, breadth first by increasing length.  An interval of
one place has reached its longest common prefix and is dropped; what is left at
``length`` is repeated, and nothing beyond is looked at.  Blocks of bytes that
double take the place of single letters, so there are few turns.

Anchors with more than ``MANY`` different stretches are dealt out by the hashes
of the strings themselves, which are counted, so no anchor has to fit a task.

Edge cases: null and empty texts have 0 bytes and no repeats; texts shorter than
``length`` neither.  Copies of a row repeat each other.  Rows that repeat a
doc_id are told apart by their content where it differs; equal ones get equal
results.  An empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigipanel.llm import tokens as tk
from vigipanel.session import cut_lineage

LENGTH = 400
GRAM = 64
MANY = 2048
ALIGNED = 8
BROADCAST_ROWS = 1_000_000      # 64-bit names, so 8 MB of values

PICKED = 2_000_000              # bytes of stretches that are handed on at once

_PICKED = ["anchor", "stretch", "n", "data", "many"]
_STRETCH = "row long, at int, n int, anchor long, stretch long"


def stretches(text: str | None, length: int = LENGTH):
    """Runs of starting places with one anchor: first place, number of places, anchor hash, hash of all their bytes."""
    data = tk.as_bytes(text)
    n = len(data) - length + 1
    if n <= 0:
        return None
    sums = tk.running(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = tk.span_hashes(sums, at, at + GRAM)
    width = length - GRAM + 1
    least = tk.sliding_minimum(grams, width)
    changed = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends, value = np.append(changed[1:], n), least[changed]
    # the grams in the windows of each run of one least hash that have it
    spots = np.flatnonzero(grams <= value.max())
    spots = spots[np.isin(grams[spots], value)]
    low = np.searchsorted(spots, changed)
    size = np.searchsorted(spots, ends - 1 + width) - low
    run = np.repeat(np.arange(len(changed)), size)
    spot = spots[np.arange(len(run)) - np.repeat(np.cumsum(size) - size - low, size)]
    own = grams[spot] == value[run]
    run, spot = run[own], spot[own]
    # places from one spot's turn to the next one's: the last gram of a window that has the least hash
    new = np.concatenate(([True], run[1:] != run[:-1]))
    turn = np.where(new, changed[run], np.maximum(spot - width + 1, changed[run]))
    until = np.where(np.append(new[1:], True), ends[run], np.append(turn[1:], n))
    first, anchor = turn[until > turn], spot[until > turn]
    count = np.diff(np.append(first, n))
    name = tk.mix(grams[anchor])
    whole = tk.span_hashes(sums, first, first + count + length - 1)
    # where the anchor lies within the stretch, so that equal stretches are equal in all
    whole = tk.mix(whole + (anchor - first).astype(np.uint64))
    return first, count, name, whole


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            rows, out = [], []
            for row, text in zip(batch["row"], batch["text"]):
                found = stretches(text, length)
                if found is not None:
                    rows.append(row)
                    out.append(found)
                if len(out) >= 500:
                    yield _stretch_frame(rows, out)
                    rows, out = [], []
            if out:
                yield _stretch_frame(rows, out)
    return run


def _stretch_frame(rows: list[int], found: list[tuple]) -> pd.DataFrame:
    first, count, name, whole = (np.concatenate(x) for x in zip(*found))
    row = np.repeat(np.array(rows, np.int64), [len(x[0]) for x in found])
    return pd.DataFrame({"row": row, "at": first.astype(np.int32), "n": count.astype(np.int32), "anchor": tk.signed(name), "stretch": tk.signed(whole)})


def equal_strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For ``starts`` within the stretches [begins, ends) of ``data``: whether the string of ``length`` occurs at another start.

    ``rank`` numbers the intervals of equal strings of the present size at every
    place; a turn extends them to the left by a block and drops intervals of one.
    """
    total = len(data)
    last = np.repeat(ends, ends - begins)                       # each place's end of stretch
    where = np.arange(total)
    alive = where + ALIGNED <= last
    padded = np.concatenate((data, np.zeros(ALIGNED, np.uint8))).astype(np.uint64)
    word = np.zeros(total, np.uint64)
    for k in range(ALIGNED):
        word = (word << np.uint64(8)) | padded[k:k + total]
    rank = np.full(total, -1, np.int64)
    size = ALIGNED
    rank, alive = _intervals(word, alive, total)
    while size < length:
        step = min(size, length - size)
        # the string of size + step at a place is its first block and the string of ``size`` that begins ``step`` further on
        ahead = np.minimum(where + step, total - 1)
        longer = alive & alive[ahead] & (where + size + step <= last)
        key = (rank.astype(np.uint64) << np.uint64(32)) | rank[ahead].astype(np.uint64)
        rank, alive = _intervals(key, longer, total)
        size += step
    return alive[starts]


def _intervals(key: np.ndarray, use: np.ndarray, total: int):
    """Numbers of equal keys among the places in use, and the places whose key is not alone."""
    places = np.flatnonzero(use)
    rank = np.zeros(total, np.int64)
    alive = np.zeros(total, bool)
    if len(places):
        order = np.argsort(key[places])
        held = key[places][order]
        new = np.concatenate(([True], held[1:] != held[:-1]))
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        rank[places[order]] = number
        alive[places[order]] = several
    return rank, alive


def _expand(length: int, budget: int = 2_000_000):
    """Rows sorted by anchor, one per different stretch, with bytes: which starting places are repeated."""

    def flush(held):
        if not held:
            return None
        whole = b"".join(h[3] for h in held)
        sizes = np.array([len(h[3]) for h in held])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        counts = np.array([h[2] for h in held])
        starts = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        again = equal_strings(np.frombuffer(whole, np.uint8), begins, ends, starts, length)
        owner = np.repeat(np.arange(len(held)), counts)
        if not again.any():
            return None
        # runs of repeated places within a stretch
        offset = starts - begins[owner]
        edge = np.flatnonzero(again & ~np.concatenate(([False], again[:-1] & (owner[1:] == owner[:-1]))))
        stop = np.flatnonzero(again & ~np.concatenate((again[1:] & (owner[1:] == owner[:-1]), [False])))
        keys = [held[k] for k in owner[edge]]
        return pd.DataFrame({"anchor": [k[0] for k in keys], "stretch": [k[1] for k in keys], "low": offset[edge], "high": offset[stop] + length})

    def run(batches):
        held, size, same = [], 0, []
        current = None
        for batch in batches:
            for anchor, stretch, n, data in zip(batch["anchor"], batch["stretch"], batch["n"], batch["data"]):
                if anchor != current:
                    held.extend(same if len(same) > 1 else [])
                    size += sum(len(h[3]) for h in same) if len(same) > 1 else 0
                    same, current = [], anchor
                    if size >= budget:
                        out = flush(held)
                        held, size = [], 0
                        if out is not None:
                            yield out
                same.append((anchor, stretch, n, data))
        held.extend(same if len(same) > 1 else [])
        out = flush(held)
        if out is not None:
            yield out

    return run


def _string_hashes(length: int):
    """For stretches of frequent anchors: a hash per starting place."""

    def run(batches):
        for batch in batches:
            for anchor, stretch, n, data in zip(batch["anchor"], batch["stretch"], batch["n"], batch["data"]):
                sums = tk.running(np.frombuffer(data, np.uint8))
                at = np.arange(n)
                yield pd.DataFrame({"anchor": anchor, "stretch": stretch, "low": at, "string": tk.signed(tk.span_hashes(sums, at, at + length))})
    return run


def _pick(batches):
    """Bytes of the wanted stretches of each row."""
    for batch in batches:
        out, size = [], 0
        for text, wanted in zip(batch["text"], batch["wanted"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            out.extend((w["anchor"], w["stretch"], w["n"], raw[w["at"]:w["at"] + w["size"]], w["many"]) for w in wanted)
            size += sum(w["size"] for w in wanted)
            if size > PICKED:
                yield pd.DataFrame(out, columns=_PICKED)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=_PICKED)


def _union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the spans cover; spans that touch are one run."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate(([True], low[1:] > reach[:-1])))
    return low[first], reach[np.append(first[1:], len(low)) - 1]


def _cut(batches):
    """row, n_removed, n_spans, kept_sha256 from the text and its spans."""
    for batch in batches:
        out = []
        for row, text, found in zip(batch["row"], batch["text"], batch["spans"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            low, high = _union(np.array([x["low"] for x in found], np.int64), np.array([x["high"] for x in found], np.int64))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(low.tolist(), high.tolist()):
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((row, int((high - low).sum()), len(low), digest.hexdigest()))
        yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "kept_sha256"])


def _with_rows(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted rows; only they are shuffled as long as their names are few enough to broadcast."""
    wanted = cut_lineage(wanted)
    if wanted.count() <= BROADCAST_ROWS:
        named = named.join(F.broadcast(wanted.select("row")), "row", "left_semi")
    return named.dropDuplicates(["row"]).join(wanted, "row")


def spans(named: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """(row, low, high): repeated byte spans of ``named(row, text)``; spans of a row may overlap."""
    found = cut_lineage(named.mapInPandas(_anchor_rows(length), _STRETCH))
    each = found.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at", "n")).alias("m"))
    kinds = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("places"))
    each = cut_lineage(each.join(kinds.where("places > 1"), "anchor").select(
        "anchor", "stretch", "times", "kinds", F.col("m.row").alias("row"), F.col("m.at").alias("at"), F.col("m.n").alias("n")))
    whole = each.where("times > 1").select("anchor", "stretch", F.lit(0).cast("long").alias("low"), (F.col("n") + length - 1).cast("long").alias("high"))
    wanted = each.where("kinds > 1").groupBy("row").agg(F.collect_list(F.struct(
        "anchor", "stretch", "at", "n", (F.col("n") + length - 1).alias("size"), (F.col("kinds") > many).alias("many"))).alias("wanted"))
    data = cut_lineage(_with_rows(named, wanted).mapInPandas(_pick, "anchor long, stretch long, n int, data binary, many boolean"))
    sorted_out = data.where("NOT many").repartition("anchor").sortWithinPartitions("anchor").mapInPandas(
        _expand(length), "anchor long, stretch long, low long, high long")
    strings = data.where("many").mapInPandas(_string_hashes(length), "anchor long, stretch long, low long, string long")
    again = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    strings = strings.join(again, "string").select("anchor", "stretch", "low", (F.col("low") + length).alias("high"))
    known = cut_lineage(whole.union(sorted_out).union(strings))
    return found.join(known, ["anchor", "stretch"]).select("row", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))


def removed(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    texts = named.select("row", "text")
    per_row = spans(texts, length, many).distinct().groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    cut = _with_rows(texts, per_row).mapInPandas(_cut, "row long, n_removed long, n_spans long, kept_sha256 string")
    whole = named.select("row", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return whole.join(cut, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
