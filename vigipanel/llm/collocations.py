"""Frequent phrases of two and three words and how firmly they stick together, per language.

A text is cut into pieces and words (``WORDS`` of a piece are what is not space
or tab).  One prefix polynomial over the word hashes of a block gives the
Rabin-Karp fingerprint of every n-gram in a few array operations; language and
length go into the fingerprint.  Three scans of the texts, each summed up per
block before the shuffle:

1. fingerprints of words and pairs are counted; the frequent ones are kept;
2. triples both of whose pairs are frequent are counted the same way (a triple
   is no more frequent than its pairs);
3. occurrences with a frequent fingerprint are pointers into the block; equal
   fingerprints are compared with the text of the first one, byte by byte, and
   only then does one phrase per block become a string with its count.

The last step sums the counts of strings, so two phrases that share a
fingerprint end apart and no collision changes a count.  Frequent fingerprints
reach the tasks as a bit table of at most ``MOST_BITS`` bits, whatever their
number; a bit set by another fingerprint costs a row, never a wrong result.

Scores are exact: products of counts are decimals of 38 digits.

Edge cases: null, empty and blank texts have no words; a null language is
``und``; repeated rows count each time; a text of any length is worked through
in blocks of about ``BLOCK`` bytes cut between pieces; equal scores are ordered
by count, then phrase; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from vigipanel.llm import tokens as tk
from vigipanel.session import cut_lineage

LEAST, TOP = 10, 2000
SCALE, COVERED = 1_000_000, 50          # a longer phrase with half of the occurrences replaces a shorter one
BLOCK = 1 << 21
BITS = 64
MOST_BITS = 1 << 28
BITS_PER_ENTRY = 16
PIECE = 1 << 10                         # words of the bit table in a row
_EXACT = "decimal(38,0)"

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True


class Block:
    """The words of some pieces of one language, and the fingerprints of their n-grams."""

    def __init__(self, data: np.ndarray, lang: str, bits: int):
        self.data, self.mask = data, np.uint64((1 << bits) - 1)
        self.starts, self.ends = tk.spans(~_GAP[data])
        self.words = tk.span_hashes(tk.running(data), self.starts, self.ends)
        self.piece = np.cumsum(_END[data])[self.starts] if len(self.starts) else self.starts
        self.salt = tk.span_hashes(tk.running(tk.as_bytes(lang)), np.zeros(1, np.int64), np.array([len(tk.as_bytes(lang))]))
        self.sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * tk.powers(len(self.words)), dtype=np.uint64, out=self.sums[1:])

    def prints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every n-gram that lies in one piece."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[size - 1:])
        raw = (self.sums[at + size] - self.sums[at]) * tk.inverse_powers(len(self.sums))[at]
        return at, tk.mix(raw + self.salt * np.uint64(2 * size + 1)) & self.mask

    def same_words(self) -> np.ndarray:
        """A number per word, equal where the bytes are equal: by hash, then compared with the first of that hash."""
        _, first, number = np.unique(self.words & self.mask, return_index=True, return_inverse=True)
        lengths = self.ends - self.starts
        of = first[number]
        good = lengths == lengths[of]
        at = np.flatnonzero(good)
        sizes = lengths[at]
        edges = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(edges - self.starts[at], sizes)
        shift = np.repeat(self.starts[of[at]] - self.starts[at], sizes)
        if len(at):
            good[at] = np.logical_and.reduceat(self.data[place] == self.data[place + shift], edges)
        names: dict[bytes, int] = {}
        for k in np.flatnonzero(~good):          # words of one hash that differ
            number[k] = len(first) + names.setdefault(self.data[self.starts[k]:self.ends[k]].tobytes(), len(names))
        return number

    def phrases(self, places: np.ndarray, size: int) -> list[str]:
        """The words from each place on, with a space between them; as they stand where the text has one space too."""
        raw, first, last = self.data.tobytes(), self.starts[places], self.ends[places + size - 1]
        single = np.ones(len(places), bool)
        for k in range(size - 1):
            end = self.ends[places + k]
            single &= (self.starts[places + k + 1] == end + 1) & (self.data[end] == 0x20)
        return [
            raw[i:j].decode("utf-8", "replace") if whole else " ".join([raw[self.starts[m]:self.ends[m]].decode("utf-8", "replace") for m in range(p, p + size)])
            for i, j, whole, p in zip(first.tolist(), last.tolist(), single.tolist(), places.tolist())
        ]


def blocks(batch: pd.DataFrame, bits: int, size: int) -> Iterator[tuple[str, Block]]:
    """The texts of a batch by language, in blocks cut between pieces."""
    texts = batch["text"].where(batch["text"].notna(), "")
    for lang, own in texts.groupby(batch["lang"].where(batch["lang"].notna(), "und"), sort=False):
        held, n = [], 0
        for text in own:
            held.append(text)
            n += len(text)
            if n >= size:
                yield from _cut(held, lang, bits, size)
                held, n = [], 0
        if n:
            yield from _cut(held, lang, bits, size)


def _cut(texts: list[str], lang: str, bits: int, size: int) -> Iterator[tuple[str, Block]]:
    data = tk.lowered(tk.as_bytes("\n".join(texts)))
    if len(data) <= 2 * size:
        yield lang, Block(data, lang, bits)
        return
    ends = np.flatnonzero(_END[data])
    start = 0
    while start < len(data):
        k = int(np.searchsorted(ends, start + size))
        stop = int(ends[k]) + 1 if k < len(ends) else len(data)
        yield lang, Block(data[start:stop], lang, bits)
        start = stop


def has(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = prints & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _counted(prints: np.ndarray) -> pd.DataFrame:
    found, n = np.unique(prints, return_counts=True)
    return pd.DataFrame({"print": tk.signed(found), "n": n})


def frequent(texts: DataFrame, counted, least: int) -> DataFrame:
    """Fingerprints that occur ``least`` times or more, with their numbers."""
    return cut_lineage(texts.mapInPandas(counted, "print long, n long").groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def bit_table(found: DataFrame):
    """Broadcast bits of the fingerprints; 64 to a word, at most ``MOST_BITS`` in all.

    Tasks set the bits; the driver gets them as bytes, a few pieces at a time.
    """
    size = 1 << 16
    while size < min(MOST_BITS, found.count() * BITS_PER_ENTRY):
        size *= 2

    def packed(batches):
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            slot = np.sort(batch["slot"].to_numpy())
            first = np.flatnonzero(np.diff(slot >> 6, prepend=-1))
            if len(first):
                bits[slot[first] >> 6] |= np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first)
        bits = bits.reshape(-1, PIECE)
        for piece in np.flatnonzero(bits.any(axis=1)).tolist():
            yield pd.DataFrame({"piece": [piece], "bits": [bits[piece].tobytes()]})

    slots = found.select(F.col("print").bitwiseAND(F.lit(size - 1)).alias("slot"))
    pieces = cut_lineage(slots.repartition(F.expr(f"slot div {64 * PIECE}")).mapInPandas(packed, "piece long, bits binary"))
    bits = np.zeros(size // 64, np.uint64)
    for row in pieces.toLocalIterator():
        bits[row["piece"] * PIECE:(row["piece"] + 1) * PIECE] = np.frombuffer(row["bits"], np.uint64)
    return found.sparkSession.sparkContext.broadcast(bits)


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = BITS, block_size: int = BLOCK) -> DataFrame:
    """(lang, phrase, size, f): all words and phrases that occur ``least`` times, and words in total as size 0.

    Fewer ``bits`` of a fingerprint make collisions likelier and change nothing else.
    """
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def short(batches):
        for batch in batches:
            for _, block in blocks(batch, bits, block_size):
                for size in (1, 2):
                    yield _counted(block.prints(size)[1])

    few = bit_table(frequent(texts, short, least))

    def triples_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
        pairs, prints = block.prints(2)
        good = np.zeros(len(block.words) + 1, bool)
        good[pairs] = has(few.value, prints)
        at, prints = block.prints(3)
        both = good[at] & good[at + 1]
        return at[both], prints[both]

    def long(batches):
        for batch in batches:
            for _, block in blocks(batch, bits, block_size):
                yield _counted(triples_of(block)[1])

    more = bit_table(frequent(texts, long, least))

    def spelled(batches):
        for batch in batches:
            for lang, block in blocks(batch, bits, block_size):
                yield from _spelled(lang, block, triples_of(block), few.value, more.value)

    found = texts.mapInPandas(spelled, "lang string, phrase string, size int, f long")
    return cut_lineage(found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(f"size = 0 OR f >= {least}"))


def _spelled(lang: str, block: Block, triples, few: np.ndarray, more: np.ndarray) -> Iterator[pd.DataFrame]:
    """Phrases with a frequent fingerprint, each once with its number in this block."""
    if not len(block.words):
        return
    yield pd.DataFrame({"lang": [lang], "phrase": [""], "size": [0], "f": [len(block.words)]})
    same = block.same_words()
    for size in (1, 2, 3):
        at, prints = triples if size == 3 else block.prints(size)
        chosen = has(more if size == 3 else few, prints)
        at, prints = at[chosen], prints[chosen]
        _, first, number, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        of = at[first[number]]
        differ = np.zeros(len(at), bool)
        for k in range(size):
            differ |= same[at + k] != same[of + k]
        n = n - np.bincount(number[differ], minlength=len(n))
        if not len(at):
            continue
        places = np.concatenate((at[first], at[differ]))          # collisions speak for themselves
        phrases = block.phrases(places, size)
        yield pd.DataFrame({"lang": lang, "phrase": phrases, "size": size, "f": np.concatenate((n, np.ones(int(differ.sum()), n.dtype)))})


def _joined(words: Column, first: int, size: int | Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate covers; the worst cut counts."""
    words = F.split("phrase", " ")
    candidates = counts.where(f"size >= 2 AND f >= {least}").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = candidates.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    ).select("*", _joined(words, 1, F.col("k")).alias("left"), F.expr("array_join(slice(split(phrase, ' '), k + 1, size - k), ' ')").alias("right"))
    part = {s: counts.where("size > 0").select("lang", F.col("phrase").alias(s), F.col("f").alias(s[0])) for s in ("left", "right")}
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    score = F.call_function("div", (a * a).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)"), l * r)
    cuts = cuts.join(part["left"], ["lang", "left"]).join(part["right"], ["lang", "right"]).withColumn("score", score)
    worst = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = candidates.where("size > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(F.array(_joined(words, 1, 2), _joined(words, 2, 2))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return worst.join(inside, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * longer < {COVERED} * a"
    ).select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    return ranked(phrase_counts(docs, least), least, top)


def ranked(counts: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counts, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
