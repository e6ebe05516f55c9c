"""Benchmark decontamination by template windows with typed slots.

Texts and benchmark items become token sequences in two forms: the literal one
(words without case) and the template, where numbers, units behind a number, and
names (capitalised inside a sentence) are typed placeholders.  Windows of
``WINDOW`` tokens meet by an equality join on their hashes; a re-parameterised
question differs in its slots only, so its templates still meet.  For each
alignment of a document with an item the slot values must map consistently: one
value of the item always stands for one value in the document.  Inserted or
deleted tokens split an alignment into neighbouring shifts; shifts up to
``MOST_GAP`` tokens apart make a chain, which is tried as one besides each alone.

Window hashes of the benchmark are sent to the tasks that scan the documents
where they are at most ``BROADCAST_WINDOWS`` (8 bytes each); beyond that all
windows are shuffled and joined.  Both ways give the same rows.

Edge cases: items with fewer than ``LEAST_TOKENS`` tokens (or null) can't be told
from chance and never match; items shorter than a window are one window.  Null or
empty documents match nothing.  Template windows need ``LEAST_LITERAL`` literal
tokens.  Rows that repeat a doc_id count as one document.  Empty tables give an
empty result; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vigipanel.llm import tokens as tk

WINDOW = 8
LEAST_TOKENS = 4
LEAST_LITERAL = 4
LEAST_COVERAGE = 0.5
MOST_GAP = WINDOW
BROADCAST_WINDOWS = 2_000_000

UNITS = "mm cm m km inch inches ft feet yard yards mile miles g kg mg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years eur usd euro euros dollar dollars cent cents percent degrees kmh mph watt watts volt volts".split()

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"()"]] = True

WINDOWS = "id long, form int, at int, hash long, slots array<long>"


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(np.array([tk.span_hashes(tk.running(d), np.array([0]), np.array([len(d)]))[0] for d in map(tk.as_bytes, words)], np.uint64))


_UNIT_HASHES = _hashes_of(UNITS)
_SLOTS = np.array([11, 22, 33], np.uint64)       # number, unit, name


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Literal token hashes, template token hashes, and which tokens are slots."""
    data = tk.as_bytes(text)
    starts, ends = tk.spans(_WORD[data])
    literal = tk.span_hashes(tk.running(tk.lowered(data)), starts, ends)
    if not len(starts):
        return literal, literal, np.zeros(0, bool)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    number = digits[ends] - digits[starts] == ends - starts
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & np.isin(literal[1:], _UNIT_HASHES)
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    name = np.zeros(len(starts), bool)
    name[1:] = capital[1:] & (stops[starts[1:]] == stops[ends[:-1]])
    slot = number | unit | name
    template = np.where(slot, np.where(number, _SLOTS[0], np.where(unit, _SLOTS[1], _SLOTS[2])), literal)
    return literal, template, slot


def _windows(key, text: str | None, sizes: list[int], known: np.ndarray | None):
    """(form, starts, hashes, slot values) of all windows, or of those among ``known``."""
    literal, template, slot = canonical(text)
    for size in sizes:
        if len(literal) < size:
            continue
        for form in (0, 1):
            if form and not slot.any():
                continue
            hashes = tk.sequence_hashes(literal if form == 0 else template, size) + np.uint64(form)
            at = np.arange(len(hashes))
            if form:
                slots = np.concatenate(([0], np.cumsum(slot)))
                n_slots = slots[size:] - slots[:-size]
                good = (n_slots > 0) & (size - n_slots >= min(LEAST_LITERAL, size))
                at, hashes = at[good], hashes[good]
            if known is not None and len(known) and len(hashes):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                good = known[place] == hashes
                at, hashes = at[good], hashes[good]
            for p, h in zip(at.tolist(), tk.signed(hashes).tolist()):
                values = tk.signed(literal[p:p + size][slot[p:p + size]]).tolist() if form else []
                yield key, form, p, h, values


def windows(rows: DataFrame, sizes: list[int] | None = None, known: np.ndarray | None = None) -> DataFrame:
    """Windows of ``rows(id, text)``; without ``sizes``, one size per row: WINDOW, or the whole of a shorter text."""
    ordered = None if known is None else np.sort(known)

    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"]):
                if pd.isna(key):
                    continue
                own = sizes
                if own is None:
                    n = len(canonical(text)[0])
                    own = [min(WINDOW, n)] if n >= LEAST_TOKENS else []
                out.extend(_windows(key, text, own, ordered))
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=["id", "form", "at", "hash", "slots"])
                    out = []
            yield pd.DataFrame(out, columns=["id", "form", "at", "hash", "slots"])

    return rows.mapInPandas(run, WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = LEAST_COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, item_id, n_matched, n_windows, coverage, n_changed, exact."""
    from vigipanel.session import cut_lineage

    items = cut_lineage(windows(benchmark.select(F.col("item_id").alias("id"), "text")))
    items = items.select(F.col("id").alias("item_id"), "form", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"))
    lengths = cut_lineage(benchmark.select(F.col("item_id").alias("id"), "text").mapInPandas(_lengths, "item_id long, n_windows long, size int"))
    sizes = sorted(r["size"] for r in lengths.select("size").distinct().collect())      # at most WINDOW values
    n = items.count()
    source = docs.select(F.col("doc_id").alias("id"), "text")
    if n <= broadcast_windows:
        known = np.array([r["hash"] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64)
        found, items = windows(source, sizes, known), F.broadcast(items)
    else:
        found = windows(source, sizes)
    met = found.distinct().join(items, ["form", "hash"]).withColumn("shift", F.col("at") - F.col("item_at"))
    met = cut_lineage(met.select(F.col("id").alias("doc_id"), "item_id", "shift", "item_at", "slots", "item_slots"))
    # the shifts of a pair in order: a wider gap begins a new chain
    order = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    shifts = met.select("doc_id", "item_id", "shift").distinct().withColumn("begins", F.coalesce(F.col("shift") - F.lag("shift").over(order) > MOST_GAP, F.lit(True)))
    shifts = shifts.withColumn("chain", F.sum(F.col("begins").cast("long")).over(order))
    several = shifts.groupBy("doc_id", "item_id", "chain").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    chains = shifts.join(several, ["doc_id", "item_id", "chain"]).select("doc_id", "item_id", "shift", "chain")
    met = met.withColumn("chained", F.lit(False)).union(
        met.join(chains, ["doc_id", "item_id", "shift"]).select("doc_id", "item_id", F.col("chain").alias("shift"), "item_at", "slots", "item_slots", F.lit(True)))
    alignment = ["doc_id", "item_id", "chained", "shift"]
    held = met.groupBy(*alignment).agg(F.countDistinct("item_at").alias("n_matched"))
    values = met.select(*alignment, F.explode(F.arrays_zip("item_slots", "slots")).alias("v")).groupBy(
        *alignment, F.col("v.item_slots").alias("value"),
    ).agg(F.min("v.slots").alias("low"), F.max("v.slots").alias("high"))
    mapped = values.groupBy(*alignment).agg(
        F.max(F.col("low") != F.col("high")).alias("clash"), F.count_if(F.col("low") != F.col("value")).alias("n_changed"),
    )
    scored = held.join(mapped, alignment, "left").join(lengths.select("item_id", "n_windows"), "item_id").select(
        "doc_id", "item_id", "chained", "n_matched", "n_windows", F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage"),
        F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"), F.coalesce("clash", F.lit(False)).alias("clash"),
    ).where(~F.col("clash") & (F.col("coverage") >= coverage))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", (-F.col("n_changed")).alias("kept"), (~F.col("chained")).alias("whole"), "n_windows", "coverage")).alias("b"))
    return best.select(
        "doc_id", "item_id", "b.n_matched", "b.n_windows", "b.coverage", (-F.col("b.kept")).alias("n_changed"),
        (F.col("b.whole") & (F.col("b.coverage") == 1) & (F.col("b.kept") == 0)).alias("exact"),
    )


def _lengths(batches):
    for batch in batches:
        out = []
        for key, text in zip(batch["id"], batch["text"]):
            n = len(canonical(text)[0])
            if n >= LEAST_TOKENS and not pd.isna(key):
                size = min(WINDOW, n)
                out.append((key, n - size + 1, size))
        yield pd.DataFrame(out, columns=["item_id", "n_windows", "size"])
