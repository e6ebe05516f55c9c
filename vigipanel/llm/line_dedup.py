"""Line deduplication by a segment-partition edit join.

Two lines are near when at most ``edits`` insertions, deletions or replacements
of characters lead from one to the other; the number follows from the shorter
line (``EDITS``: 2 from 80 characters on, 1 from 40 on, else 0).  A line of
length l is cut into edits + 1 segments.  A near line of length l to l + edits
holds one of them unchanged, at one of a few places that its position and the
difference in length leave open.  Segments, and those substrings, are keys of an
equality join; candidates are verified with a banded bit-parallel edit distance.
Lines under a key that more than ``MANY`` share meet again under finer keys,
threes of six parts, of which near lines also share one.  A key under which no
line has a segment of its own gives nothing.  A key of two lines is a
pair; the lines of a larger one meet hubs first (``hubs.linked``).  Those that are
in different classes after that are joined exactly on their rare grams: an edit
changes at most ``GRAM`` grams of ``GRAM`` characters, so of a line's grams in one
order for all lines, near lines share one of the first GRAM * edits + 1.  It also
changes at most two counts of characters by one, so lines whose counts differ in
more than 2 * edits never leave that join, and no pair of them is verified.
Lines connected by near links are one class, of which the first line by
(doc_id, line number) stays; equal lines are one line from the start.

Lines are compared without the white space around them; blank lines are left
alone.

Edge cases: null and empty texts have no lines.  Rows with one doc_id and one
text count as one document, whose lines stay or go in all of them; rows that
share a doc_id only, or have none, are documents of their own.  A null doc_id
sorts first.  An empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from vigipanel.llm import tokens as tk
from vigipanel.llm.groups import components, rows_per_batch, with_texts
from vigipanel.llm.hubs import linked, once, sharing
from vigipanel.session import cut_lineage

EDITS = ((80, 2), (40, 1))         # characters from which on so many edits are allowed
MANY = 32
CHUNK = 100_000                    # characters that are hashed at once
SEEN = 1 << 18                     # places for lines that a task remembers, to give the keys of equal ones once
VERIFIED = 2_000                   # pairs that are verified at once, after those that cannot be near
BINS = 32                          # kinds of characters that are counted for that
BROADCAST_ROWS = 500_000
GRAM = 4
OFTEN = 16                         # grams of a slot up to which they are rare
SLOTS = 1 << 18                    # a power of two; numbers that order the grams of all lines
_CODES = tk.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def edits_for(length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(length), np.int64)
    for least, edits in reversed(EDITS):
        out[length >= least] = edits
    return out


def _chunks(texts: pd.Series):
    """Runs of rows of about ``CHUNK`` characters: (first row, texts)."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text if isinstance(text, str) else "")
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def lines_of(texts: list[str]):
    """Row, line number, start and end of all lines that aren't blank, and running sums over all characters."""
    data = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.append(breaks, len(data))
    counts = np.array([t.count("\n") + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    solid = np.flatnonzero((data != 0x20) & (data - np.uint32(9) > 4))         # no white space; 9 to 13 are, and less wraps around
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = high > low
    row, number, low, high = row[full], number[full], low[full], high[full]
    values = _CODES[data] if data.max(initial=0) < len(_CODES) else tk.mix(data.astype(np.uint64) + np.full(1, 1, np.uint64))
    values *= tk._powers(tk._STEP, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=sums[1:])
    return row, number, solid[low], solid[high - 1] + 1, sums


def _names(sums, starts, ends) -> np.ndarray:
    """63-bit names of lines; the lowest bit is free for a role."""
    return tk.signed(tk.span_hashes(sums, starts, ends) & np.uint64(0xFFFFFFFFFFFFFFFE))


def _line_rows(batches):
    for batch in batches:
        for first, texts in _chunks(batch["text"]):
            row, number, starts, ends, sums = lines_of(texts)
            yield pd.DataFrame({"row": batch["row"].iloc[first + row].to_numpy(), "doc_id": batch["doc_id"].iloc[first + row].to_numpy(), "line_no": number.astype(np.int32), "line": _names(sums, starts, ends)})


def keys_of(sums, starts, ends):
    """(line index, key, role) of every segment (role 0) and probed substring (role 1)."""
    out = []

    def add(index, at, size, length, part, role):
        key = tk.span_hashes(sums, at, at + size)
        tag = (length * 8 + part).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        out.append((index, tk.mix(key ^ tag), np.full(len(index), role, np.int64)))

    total = ends - starts
    for _, edits in EDITS:
        for shift in range(edits + 1):
            length = total - shift                       # of the shorter line
            index = np.flatnonzero((edits_for(np.maximum(length, 0)) == edits) & (length > 0))
            base, rest = length[index] // (edits + 1), length[index] % (edits + 1)
            place = np.zeros(len(index), np.int64)
            for part in range(edits + 1):
                size = base + (part >= edits + 1 - rest)
                low = max(-part, shift - (edits - part))
                high = min(part, shift + (edits - part))
                for move in range(low, high + 1):
                    at = place + move
                    fits = (at >= 0) & (at + size <= total[index])
                    role = 0 if shift == 0 and move == 0 else 1
                    chosen = index[fits]
                    add(chosen, starts[chosen] + at[fits], size[fits], length[chosen], np.full(len(chosen), part), role)
                place = place + size
    return [np.concatenate(x) for x in zip(*out)]


def _key_rows(batches):
    seen = np.ones(SEEN, np.int64)                 # names are even
    for batch in batches:
        for _, texts in _chunks(batch["text"]):
            _, _, starts, ends, sums = lines_of(texts)
            long = ends - starts >= EDITS[-1][0]
            starts, ends = starts[long], ends[long]
            if not len(starts):
                continue
            names, first = np.unique(_names(sums, starts, ends), return_index=True)
            place = names >> 1 & SEEN - 1
            new = seen[place] != names
            names, first = names[new], first[new]
            seen[place[new]] = names
            if not len(names):
                continue
            index, key, role = keys_of(sums, starts[first], ends[first])
            yield pd.DataFrame({"key": tk.signed(key), "item": names[index] | role})


def _paths(edits: int, shift: int) -> list[tuple[int, ...]]:
    """Places of three unchanged parts, relative to the shorter line, when all edits together are few enough."""
    moves = range(-edits, edits + 1)
    return [
        (x, y, z) for x in moves for y in moves for z in moves if abs(x) + abs(y - x) + abs(z - y) + abs(shift - z) <= edits
    ]


def _triples(edits: int) -> list[tuple[int, int, int]]:
    """Threes of the parts of which any ``PARTS - edits`` parts hold at least one."""
    if edits == 1:
        return [(0, 1, 2), (3, 4, 5)]
    return [tuple(sorted((2 * k, 2 * k + 1, (2 * k + 2 + j) % PARTS))) for k in range(3) for j in range(2)]


PARTS = 6
_FINE = {e: (_triples(e), {d: _paths(e, d) for d in range(e + 1)}) for _, e in EDITS}


def fine_keys(text: str):
    """(key, role) from three parts of six at a time: what near lines share beyond one segment."""
    _, _, starts, ends, sums = lines_of([text])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    origin, total = int(starts[0]), int(ends[0] - starts[0])
    at, size, tags, roles = [], [], [], []
    for shift in range(EDITS[0][1] + 1):
        length = total - shift
        edits = int(edits_for(np.array([length]))[0]) if length > 0 else 0
        if edits < max(shift, 1):
            continue
        base, rest = divmod(length, PARTS)
        sizes = [base + (k >= PARTS - rest) for k in range(PARTS)]
        places = [sum(sizes[:k]) for k in range(PARTS)]
        triples, paths = _FINE[edits]
        for number, triple in enumerate(triples):
            for path in paths[shift]:
                spots = [places[k] + move for k, move in zip(triple, path)]
                if spots[0] < 0 or any(x + sizes[k] > total for x, k in zip(spots, triple)):
                    continue
                at.append(spots)
                size.append([sizes[k] for k in triple])
                tags.append(length * 16 + number)
                roles.append(0 if shift == 0 and not any(path) else 1)
    if not at:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at, size = np.array(at) + origin, np.array(size)
    parts = tk.span_hashes(sums, at.ravel(), (at + size).ravel()).reshape(at.shape)
    keys = np.array(tags, np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(3):
        keys = tk.mix(keys ^ parts[:, k])
    return keys, np.array(roles, np.int64)


def _fine_rows(batches):
    for batch in batches:
        for item, text in zip(batch["item"], batch["text"]):
            keys, roles = fine_keys(text)
            if len(keys):
                yield pd.DataFrame({"key": tk.signed(keys), "item": roles | item})


def _candidates(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of lines, and (key, item) of frequent keys, from meetings of items whose lowest bit is their role; two probes need no comparison."""
    role_a, role_b = F.col("a").bitwiseAND(F.lit(1)), F.col("b").bitwiseAND(F.lit(1))
    a, b = F.col("a") - role_a, F.col("b") - role_b
    pairs = met.where(~F.col("many") & ((role_a == 0) | (role_b == 0))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    many = met.where("many").select(F.col("a").alias("key"), b.alias("item")).distinct()
    return cut_lineage(pairs), cut_lineage(many)


def grams_of(text: str) -> np.ndarray:
    """The grams of a line, the k-th occurrence of one told from the others."""
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = tk.sequence_hashes(data.astype(np.uint64), GRAM)
    order = np.argsort(grams, kind="stable")
    held = grams[order]
    first = np.concatenate(([True], held[1:] != held[:-1])) if len(held) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    turn = np.arange(len(held)) - np.repeat(start, np.diff(np.append(start, len(held))))
    return tk.mix(held + turn.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def counts_of(texts) -> np.ndarray:
    """A row per text: how often it has characters of each kind."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    return np.bincount(row * BINS + data % BINS, minlength=len(texts) * BINS).reshape(-1, BINS)


def _slot(grams: np.ndarray, slots: int) -> np.ndarray:
    return (grams & np.uint64(slots - 1)).astype(np.int64)


def _slot_rows(slots: int):
    """How many grams of a task's lines fall into each slot."""

    def run(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch["text"]):
                total += np.bincount(_slot(np.concatenate([grams_of(text) for text in texts]), slots), minlength=slots)
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot.astype(np.int32), "n": total[slot]})

    return run


def _head_rows(rank: np.ndarray):
    """The first grams of each line, in the order of ``rank`` and hash, with its counts of characters."""

    def run(batches):
        for batch in batches:
            for first, texts in _chunks(batch["text"]):
                length = np.array([len(text) for text in texts])
                heads = []
                for text, edits in zip(texts, edits_for(length).tolist()):
                    grams = grams_of(text)
                    heads.append(grams[np.lexsort((grams, rank[_slot(grams, len(rank))]))[:GRAM * edits + 1]])
                each = np.repeat(np.arange(len(texts)), [len(x) for x in heads])
                item, root = (batch[c].to_numpy()[first + each] for c in ("item", "root"))
                counts = np.minimum(counts_of(texts), np.iinfo(np.int16).max).astype(np.int16)      # no difference grows by that
                yield pd.DataFrame({"item": item, "root": root, "length": length[each], "gram": tk.signed(np.concatenate(heads)), "counts": list(counts[each])})

    return run


def rare_pairs(lines: DataFrame) -> DataFrame:
    """Pairs (a < b) of ``lines(item, root, text)`` with different roots that can be near, exact: no near pair is left out.

    All grams have one order: by the number of grams in their slot, of ``SLOTS``
    by hash, and then by their hashes; numbers of up to ``OFTEN`` count as one.
    The numbers decide how many pairs meet, not which near ones do, so a table of
    ``SLOTS`` numbers serves any input, and each line hands on its first grams only.
    """
    lines = cut_lineage(lines)
    held = lines.select("text").mapInPandas(_slot_rows(SLOTS), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    rank = np.zeros(SLOTS, np.int64)
    rank[held["slot"].to_numpy()] = held["n"].to_numpy()
    rank[rank <= OFTEN] = 0
    heads = cut_lineage(lines.mapInPandas(_head_rows(rank), "item long, root long, length long, gram long, counts array<short>"))
    main = heads.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("gram").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("gram", "main")
    heads = cut_lineage(heads.join(main, "gram"))
    # lines of the component that holds most lines of a gram never meet each other
    one = heads.where("root <> main").select("gram", F.col("item").alias("i"), F.col("root").alias("ri"), F.col("length").alias("li"), F.col("counts").alias("ci"))
    two = heads.select("gram", F.col("item").alias("j"), F.col("root").alias("rj"), F.col("length").alias("lj"), F.col("counts").alias("cj"))
    differing = F.aggregate(F.zip_with("ci", "cj", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    most = EDITS[0][1]
    met = one.join(two, "gram").where((F.col("ri") != F.col("rj")) & (F.abs(F.col("li") - F.col("lj")) <= most) & (differing <= 2 * most))
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def within(one: list[str], two: list[str], edits: int) -> np.ndarray:
    """Which pairs are at most ``edits`` apart; each text is longer than ``edits``.

    A band of 2 * edits + 1 rows around the diagonal is one word of bits per
    pair; all pairs go through their columns together.
    """
    m, n = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    near = np.abs(m - n) <= edits
    width = 2 * edits + 1
    pattern = np.full((len(one), max(m.max(initial=0), n.max(initial=0)) + width), 0xFFFFFFFF, np.uint32)
    column = np.full((len(two), n.max(initial=0)), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(zip(one, two)):
        pattern[k, edits:edits + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        column[k, :len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = (1 << width) - 1
    up = np.full(len(one), (mask >> edits) << edits, np.int64)      # rows where the next value is higher
    down = np.zeros(len(one), np.int64)
    score = np.full(len(one), edits, np.int64)
    for i in range(column.shape[1]):
        equal = np.zeros(len(one), np.int64)
        for b in range(width):
            equal |= (pattern[:, i + b] == column[:, i]).astype(np.int64) << b
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up = (down | ~(diagonal | up)) & mask
        right_down = diagonal & up & mask
        last = m - 1 - i + edits                                      # bit of the last row
        step = np.where(last >= width - 1, 1 - ((diagonal >> (width - 1)) & 1), ((right_up >> np.maximum(last, 0)) & 1) - ((right_down >> np.maximum(last, 0)) & 1))
        score += np.where((i < n) & (last >= 0), step, 0)
        shifted = (diagonal & mask) >> 1
        up = (right_down | ~(shifted | right_up)) & mask
        down = shifted & right_up
    return near & (score <= edits)


def possible(one: list[str], two: list[str], edits: np.ndarray) -> np.ndarray:
    """Pairs whose counts of characters leave so few edits possible: one edit changes one count, or two, by one."""
    return np.abs(counts_of(one) - counts_of(two)).sum(axis=1) <= 2 * edits


def _near(batches):
    held, size = [], 0
    for batch in batches:
        one, two = batch["text_a"].to_numpy(), batch["text_b"].to_numpy()
        allowed = edits_for(np.array([min(len(x), len(y)) for x, y in zip(one, two)], np.int64))
        ends = np.cumsum([len(x) + len(y) for x, y in zip(one, two)])
        at, good = 0, np.zeros(len(batch), bool)
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
            good[at:stop] = possible(list(one[at:stop]), list(two[at:stop]), allowed[at:stop])
            at = stop
        held.append(batch[good & (allowed > 0)])
        size += len(held[-1])
        if size >= VERIFIED:
            yield _verified(pd.concat(held))
            held, size = [], 0
    if size:
        yield _verified(pd.concat(held))


def _verified(batch: pd.DataFrame) -> pd.DataFrame:
    """The near pairs (a, b)."""
    one, two = batch["text_a"].to_numpy(), batch["text_b"].to_numpy()
    sizes = np.array([max(len(x), len(y)) for x, y in zip(one, two)], np.int64)
    allowed = edits_for(np.array([min(len(x), len(y)) for x, y in zip(one, two)], np.int64))
    good = np.zeros(len(batch), bool)
    for edits in {e for _, e in EDITS}:
        rows = np.flatnonzero(allowed == edits)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        at = 0
        while at < len(rows):
            step = max(1, min(2000, 1_000_000 // int(sizes[rows[min(at + 999, len(rows) - 1)]])))
            part = rows[at:at + step]
            good[part] = within(list(one[part]), list(two[part]), edits)
            at += step
    return batch.loc[good, ["a", "b"]]


def _line_texts(docs: DataFrame, wanted: DataFrame, first: DataFrame) -> DataFrame:
    """(item, text) of the wanted lines, taken from the row of ``docs(row, text)`` that has each first."""
    places = cut_lineage(wanted.join(first, wanted["item"] == first["line"]).select("item", F.col("first.row").alias("row"), "first.line_no"))
    hint = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    texts = docs.select("row", "text").join(hint, "row")
    line = F.get(F.split("text", "\n"), F.col("line_no"))
    return cut_lineage(texts.select("item", F.btrim(line, F.lit(" \t\n\x0b\f\r")).alias("text")).dropDuplicates(["item"]))


def _row() -> Column:
    """The name of a row: a doc_id may be null or stand for several texts."""
    return F.xxhash64("doc_id", "text")


def classed(docs: DataFrame) -> DataFrame:
    """row (name), doc_id, line_no, line (name), line_class, stays for every line that isn't blank."""
    docs = docs.select("doc_id", "text", _row().alias("row"))
    lines = cut_lineage(docs.mapInPandas(_line_rows, "row long, doc_id long, line_no int, line long"))
    first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    pairs, many = _candidates(cut_lineage(sharing(docs.mapInPandas(_key_rows, "key long, item long"), probes=True)))
    wanted = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("item")), F.struct(F.col("b").alias("item"))))).union(many.select("item")).distinct()
    texts = _line_texts(docs, wanted, first)
    large = cut_lineage(many.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MANY).select("key"))
    crowded = texts.join(many.join(large, "key", "left_semi").select("item").distinct(), "item", "left_semi")
    more, fine = _candidates(cut_lineage(sharing(crowded.mapInPandas(_fine_rows, "key long, item long"), probes=True)))
    pairs = cut_lineage(pairs.union(more).distinct())
    many, _ = once(many.join(large, "key", "left_anti").union(fine))

    def verified(found: DataFrame) -> DataFrame:
        return cut_lineage(with_texts(found, texts).mapInPandas(_near, "a long, b long"))

    with rows_per_batch(docs.sparkSession, 2000):
        links, left = linked(pairs, many, verified)
        if not left.isEmpty():
            open_ = left.select("item", "root").distinct().join(texts, "item")
            links = links.union(verified(rare_pairs(open_.select("item", "root", "text"))))
    roots = cut_lineage(components(links))
    hint = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    held = lines.join(hint, F.col("line") == F.col("node"), "left").select("row", "doc_id", "line_no", "line", F.coalesce("root", "line").alias("line_class"))
    keeper = first.join(hint, F.col("line") == F.col("node"), "left").groupBy(F.coalesce("root", "line").alias("class")).agg(
        F.min("first").alias("keeper"), F.sum("n").alias("n")).where("n > 1").select("class", "keeper")
    return held.join(keeper, F.col("line_class") == F.col("class"), "left").select(
        "row", "doc_id", "line_no", "line", "line_class",
        F.when(F.col("class").isNull(), True).otherwise(F.struct("doc_id", "line_no", "row").eqNullSafe(F.col("keeper"))).alias("stays"),
    )


def counted(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id and text): doc_id, n_lines, n_removed, removed (sorted line numbers, from 0)."""
    lines = classed(docs).groupBy("row").agg(
        F.size(F.collect_set("line_no")).cast("long").alias("n_lines"),         # a repeated row has its lines once
        F.array_sort(F.collect_set(F.when(~F.col("stays"), F.col("line_no")))).alias("removed"),
    ).withColumn("n_removed", F.size("removed").cast("long"))
    rows = docs.select("doc_id", _row().alias("row")).distinct()
    return rows.join(lines, "row", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


@F.pandas_udf(StringType())
def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, removed):
        if text is not None and gone is not None and len(gone):
            gone = set(gone.tolist())
            text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
        out.append(text)
    return pd.Series(out, dtype=object)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; n_chars follows; documents that lose all their lines go."""
    gone = classed(docs).where("NOT stays").groupBy("row").agg(F.collect_set("line_no").alias("removed"))
    # the columns of docs travel in one struct, so none of them can clash with these names
    rows = docs.select(F.struct("*").alias("doc"), _row().alias("row")).join(gone, "row", "left")
    rows = rows.withColumn("text", _without(F.col("doc.text"), F.col("removed")))
    rows = rows.where(F.col("removed").isNull() | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    out = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("removed").isNull(), out["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[column.alias(name) for name, column in out.items()])
