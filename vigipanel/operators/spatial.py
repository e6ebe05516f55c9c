"""Global and local spatial autocorrelation with reproducible permutation tests.

``values``: ``year, code, value`` (one row per area); ``edges``: ``rule, src,
dst, weight`` (weights of a source sum to one).  The weight matrix is never
built: everything is a join with the edge table.

Permutations are keyed bijections of the areas' positions in code order
(``bijection``): an area finds from its own position where each permutation deals
its value, or whose value it is dealt, so nothing is sorted, and any engine can
repeat them.  Up to ``_HELD`` values reach all tasks, where a block of areas looks
up what it and its neighbours are dealt, so no dealt value is written.  Beyond,
dealt values and their sums travel as blocks, matrices of a few areas by all
permutations.  p-values agree with a pseudo-random generator in distribution, not bit for bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions.indicators import quadrant, significant
from vigipanel.operators import bijection
from vigipanel.operators.ranking import row_positions
from vigipanel.session import cut_lineage

_CELLS = 1 << 19     # numbers in a block, about
_DEALT = 1 << 21     # numbers dealt or multiplied at once, about
_TASK = 1 << 22      # numbers a task deals, about
_HELD = 1 << 24      # values that every task may hold, in all years: 128 MB at most
_PIECE = 1 << 16     # values that reach the driver in one row
_WIDER = 4           # blocks in a stretch of areas that looks values up: its neighbours beyond it are looked up as well
_DIGITS = 12         # simulated and observed values are compared at this precision


def centred(values: DataFrame) -> DataFrame:
    """Values minus the yearly mean ``z``, with the areas ``n`` and ``sum(z*z)``; one row per year is broadcast."""
    means = values.groupBy("year").agg(F.avg("value").alias("_m"), F.count("value").alias("n"))
    z = values.join(F.broadcast(means), "year").withColumn("z", F.col("value") - F.col("_m"))
    squares = z.groupBy("year").agg(F.sum(F.col("z") * F.col("z")).alias("zz"))
    return z.join(F.broadcast(squares), "year").drop("_m")


def spatial_lag(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted mean of the neighbours' centred values per area, year and rule."""
    z = centred(values)
    lag = (
        edges.join(z.select("year", F.col("code").alias("dst"), F.col("z").alias("zd")), "dst")
        .groupBy("rule", "year", F.col("src").alias("code"))
        .agg(F.sum(F.col("weight") * F.col("zd")).alias("lag"))
    )
    return z.join(lag, ["year", "code"])


def _global_coefficient(lagged: DataFrame) -> DataFrame:
    """n / sum(W) * z'Wz / z'z; rows of W sum to one, so sum(W) is the source count."""
    return lagged.groupBy("rule", "year").agg(
        F.count(F.lit(1)).alias("areas"),
        F.try_divide(
            F.max("n") * F.sum(F.col("z") * F.col("lag")), F.count(F.lit(1)) * F.max("zz")
        ).alias("moran_i"),
        F.try_divide(F.max("n"), F.count(F.lit(1)) * F.max("zz")).alias("factor"),
    )


def observed_coefficients(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Global coefficient per rule and year, without a test."""
    return _global_coefficient(spatial_lag(values, edges)).drop("factor")


def _block_areas(permutations: int) -> int:
    """Areas of a block: its matrix and the places in it stay small for any number of permutations."""
    return max(1, _CELLS // max(permutations, 1))


def _placed(values: DataFrame) -> DataFrame:
    """Rows ``year, code, z, n, position``, positions from 0 in code order."""
    z = centred(values)
    return cut_lineage(row_positions(z.select("year", "code", "z", F.col("n").cast("long").alias("n")), ["year"], ["code"]).select(
        F.col("year").cast("long").alias("year"), "code", "z", "n", (F.col("position") - 1).cast("long").alias("position")))


def _sides(placed: DataFrame) -> DataFrame:
    """``year, n, a, b``: the sides of the cells of each year's permutations, one row per year."""
    sizes = placed.groupBy("year").agg(F.max("n").alias("n"))
    return sizes.select("year", "n", bijection.sides(F.col("n")).alias("c")).select("year", "n", "c.a", "c.b")


def _dealt_blocks(placed: DataFrame, permutations: int, seed: int, seed_plus_year: bool) -> DataFrame:
    """Rows ``year, block, dealt``: what each permutation (column) deals to the areas of a block (rows), as bytes of doubles.

    The one exchange takes dealt values to their blocks; the order of a
    permutation is never built.
    """
    size = _block_areas(permutations)
    cells = _sides(placed).select("year", "a", "b")
    tasks = max(1, placed.count() * permutations // _TASK)
    rows = placed.select("year", "position", "z", "n").repartition(tasks, "position").join(F.broadcast(cells), "year")

    def deal(batches):
        for batch in batches:
            for (year, n, a, b), part in batch.groupby(["year", "n", "a", "b"]):
                z, positions = part["z"].to_numpy(), part["position"].to_numpy()
                step = max(1, _DEALT // len(part))
                for start in range(0, permutations, step):
                    perms = np.arange(start, min(start + step, permutations))
                    key = bijection.keys(seed + (int(year) if seed_plus_year else 0), int(year), perms + 1)
                    to = bijection.dealt(positions, int(n), int(a), int(b), key)
                    block, slot = (to // size).ravel(), ((to % size) * permutations + perms[:, None]).astype(np.int32).ravel()
                    order = np.argsort(block.astype(np.int32), kind="stable")
                    block, slot, dealt = block[order], slot[order], np.broadcast_to(z, to.shape).ravel()[order]
                    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
                    found = [(year, block[i], n, slot[i:j].tobytes(), dealt[i:j].tobytes()) for i, j in zip(edges[:-1], edges[1:])]
                    yield pd.DataFrame(found, columns=["year", "block", "n", "slots", "dealt"])

    def assemble(key, parts):
        matrix = np.full((min(size, int(parts["n"].iloc[0]) - int(key[1]) * size), permutations), np.nan)
        for slots, dealt in zip(parts["slots"], parts["dealt"]):
            matrix.reshape(-1)[np.frombuffer(slots, np.int32)] = np.frombuffer(dealt)
        return pd.DataFrame([(*key, matrix.tobytes())], columns=["year", "block", "dealt"])

    sent = rows.mapInPandas(deal, "year long, block long, n long, slots binary, dealt binary")
    return cut_lineage(sent.groupBy("year", "block").applyInPandas(assemble, "year long, block long, dealt binary"))


def dealt_values(values: DataFrame, permutations: int, seed: int, seed_plus_year: bool) -> DataFrame:
    """Rows ``year, code, dealt``: the centred values that each permutation deals to an area, as one array."""
    placed, size = _placed(values), _block_areas(permutations)

    def rows(batches):
        for batch in batches:
            for year, block, dealt in zip(batch["year"], batch["block"], batch["dealt"]):
                matrix = np.frombuffer(dealt).reshape(-1, permutations)
                yield pd.DataFrame({"year": year, "position": block * size + np.arange(len(matrix)), "dealt": list(matrix)})

    dealt = _dealt_blocks(placed, permutations, seed, seed_plus_year).mapInPandas(rows, "year long, position long, dealt array<double>")
    return placed.join(dealt, ["year", "position"]).select("year", "code", "dealt")


def _held_values(placed: DataFrame):
    """Broadcast: the values of each year in order of their positions.  They reach the driver as bytes."""
    def packed(key, rows):
        rows = rows.sort_values("position")
        return pd.DataFrame([(key[0], key[1], rows["z"].to_numpy(np.float64).tobytes())], columns=["year", "piece", "z"])

    rows = placed.select("year", "position", "z", F.expr(f"position div {_PIECE}").alias("piece"))
    pieces = cut_lineage(rows.groupBy("year", "piece").applyInPandas(packed, "year long, piece long, z binary"))
    held = {r["year"]: np.empty(r["n"]) for r in _sides(placed).collect()}
    for row in pieces.toLocalIterator():
        found = np.frombuffer(row["z"])
        held[row["year"]][row["piece"] * _PIECE:row["piece"] * _PIECE + len(found)] = found
    return placed.sparkSession.sparkContext.broadcast(held)


def _looked_up_lags(placed: DataFrame, edges: DataFrame, permutations: int, seed: int, seed_plus_year: bool, give, schema: str) -> DataFrame:
    """``_with_lags`` where every task holds all values: a stretch of areas finds by itself what it and its neighbours are dealt."""
    held, sides, size = _held_values(placed), {r["year"]: (r["n"], r["a"], r["b"]) for r in _sides(placed).collect()}, _WIDER * _block_areas(permutations)
    at = placed.select("year", "code", "position")
    ends = edges.join(at.select("year", F.col("code").alias("dst"), F.col("position").alias("source")), "dst").join(
        at.select("year", F.col("code").alias("src"), F.col("position").alias("own")), ["year", "src"]
    ).select("rule", "year", "own", "source", "weight", F.expr(f"own div {size}").alias("block"))
    names = [field.split()[0] for field in schema.split(", ")]
    chunk, most = max(1, _DEALT // max(permutations, 1) // 2), max(1, 2 * _DEALT // max(permutations, 1))

    def lags(key, ends):
        year = int(key[0])
        z, (n, a, b) = held.value[year], sides[year]
        keys = bijection.keys(seed + (year if seed_plus_year else 0), year, np.arange(1, permutations + 1))

        def dealt_to(positions):
            out = np.empty((len(positions), permutations))
            for i in range(0, len(positions), chunk):
                out[i:i + chunk] = z[bijection.drawn(positions[i:i + chunk], n, a, b, keys)].T
            return out

        rows, own = np.unique(ends["own"].to_numpy(), return_inverse=True)
        there, source = np.unique(ends["source"].to_numpy(), return_inverse=True)
        dealt, rules = dealt_to(rows), ends["rule"].to_numpy()
        weight = ends["weight"].to_numpy(np.float64)
        lag = {rule: np.zeros(dealt.shape) for rule in dict.fromkeys(rules)}
        order = np.lexsort((source, own, source // most))
        for k in range(0, len(there), most):                    # values of so many neighbours are held at a time
            matrix = dealt_to(there[k:k + most])
            slab = order[slice(*np.searchsorted(source[order] // most, (k // most, k // most + 1)))]
            for rule, added in lag.items():
                part = slab[rules[slab] == rule]
                for i in range(0, len(part), chunk):
                    some = part[i:i + chunk]
                    first = np.flatnonzero(np.diff(own[some], prepend=-1))
                    if len(first):
                        added[own[some][first]] += np.add.reduceat(matrix[source[some] - k] * weight[some, None], first, axis=0)
        found = []
        for rule, added in lag.items():
            seen = np.unique(own[rules == rule])
            found.extend(give(rule, year, rows[seen], dealt[seen], added[seen]))
        return pd.DataFrame(found, columns=names)

    return ends.groupBy("year", "block").applyInPandas(lags, schema)


def _with_lags(values: DataFrame, edges: DataFrame, permutations: int, seed: int, seed_plus_year: bool, give, schema: str) -> DataFrame:
    """``give(rule, year, positions, dealt, lags)`` for the areas of each block that have neighbours, rows of ``schema``.

    ``dealt`` are the areas' own dealt values, ``lags`` the weighted sums of the
    neighbours', by permutation.  Of more than ``_HELD`` values, edges go to the block of their neighbour, which
    adds up what it holds for each area; these sums, one per area and block at
    most, go to the block of the area.
    """
    placed, size = _placed(values), _block_areas(permutations)
    if placed.count() <= _HELD:
        return _looked_up_lags(placed, edges, permutations, seed, seed_plus_year, give, schema)
    blocks = _dealt_blocks(placed, permutations, seed, seed_plus_year)
    at = placed.select("year", "code", (F.col("position") / size).cast("long").alias("block"), (F.col("position") % size).alias("row"))
    ends = edges.join(at.select("year", F.col("code").alias("dst"), F.col("block").alias("from_block"), F.col("row").alias("from_row")), "dst").join(
        at.select("year", F.col("code").alias("src"), F.col("block").alias("to_block"), F.col("row").alias("to_row")), ["year", "src"]
    ).select("rule", "year", "from_block", "from_row", "to_block", "to_row", "weight")
    chunk = max(1, _DEALT // max(permutations, 1) // 2)

    def add(key, ends, held):
        matrix = np.frombuffer(held["dealt"].iloc[0]).reshape(-1, permutations) if len(held) else None
        found = []
        for (rule, to_block), part in ends.groupby(["rule", "to_block"]) if len(held) else ():
            part = part.sort_values("to_row")
            to, source, weight = (part[c].to_numpy() for c in ("to_row", "from_row", "weight"))
            for i in range(0, len(part), chunk):
                some = to[i:i + chunk]
                first = np.flatnonzero(np.diff(some, prepend=-1))
                sums = np.add.reduceat(matrix[source[i:i + chunk]] * weight[i:i + chunk, None], first, axis=0)
                found.append((rule, key[0], to_block, some[first].astype(np.int64).tobytes(), sums.tobytes()))
        return pd.DataFrame(found, columns=["rule", "year", "block", "rows", "sums"])

    sums = ends.groupBy("year", "from_block").cogroup(blocks.groupBy("year", "block")).applyInPandas(
        add, "rule string, year long, block long, rows binary, sums binary")

    def lags(key, sums, held):
        dealt = np.frombuffer(held["dealt"].iloc[0]).reshape(-1, permutations) if len(held) else None
        found = []
        for rule, part in sums.groupby("rule") if len(held) else ():
            lag, seen = np.zeros(dealt.shape), np.zeros(len(dealt), bool)
            for rows, added in zip(part["rows"], part["sums"]):
                rows = np.frombuffer(rows, np.int64)
                lag[rows] += np.frombuffer(added).reshape(-1, permutations)
                seen[rows] = True
            rows = np.flatnonzero(seen)
            found.extend(give(rule, int(key[0]), int(key[1]) * size + rows, dealt[rows], lag[rows]))
        return pd.DataFrame(found, columns=names)

    names = [field.split()[0] for field in schema.split(", ")]
    return sums.groupBy("year", "block").cogroup(blocks.groupBy("year", "block")).applyInPandas(lags, schema)


def _complete(values: DataFrame) -> DataFrame:
    """The values, written once; a missing one is an error, as the coefficients need all areas."""
    values = cut_lineage(values)
    missing = values.where(F.col("value").isNull()).count()
    if missing:
        raise ValueError(f"{missing} values are missing; every area needs one in every year")
    return values


def _extreme(simulated, observed):
    return F.round(F.abs(simulated), _DIGITS) >= F.round(F.abs(observed), _DIGITS)


def moran_global(values: DataFrame, edges: DataFrame, permutations: int = fv.PERMUTATIONS,
                 seed: int = fv.PERMUTATION_SEED, seed_plus_year: bool = False) -> DataFrame:
    """Global coefficient, its expectation and two-sided permutation p per rule and year.

    Constant values have no coefficient (null); ``quality.spatial_ready`` reports them.
    """
    values, edges = _complete(values), cut_lineage(edges.select("rule", "src", "dst", "weight"))
    observed = _global_coefficient(spatial_lag(values, edges))
    def totals(rule, year, positions, dealt, lags):
        return [(rule, year, (dealt * lags).sum(axis=0))]

    terms = _with_lags(values, edges, permutations, seed, seed_plus_year, totals, "rule string, year long, terms array<double>").select(
        "rule", "year", F.posexplode("terms").alias("perm", "term"))
    simulated = terms.groupBy("rule", "year", "perm").agg(F.sum("term").alias("total"))
    counted = (
        simulated.join(observed, ["rule", "year"]).groupBy("rule", "year")
        .agg(F.count_if(_extreme(F.col("total") * F.col("factor"), F.col("moran_i"))).alias("_hits"))
    )
    used_seed = F.lit(seed) + F.col("year") if seed_plus_year else F.lit(seed)
    return observed.join(counted, ["rule", "year"]).select(
        "year", "areas", "moran_i",
        F.try_divide(F.lit(-1.0), F.col("areas") - 1).alias("expected"),
        F.when(F.col("moran_i").isNotNull(), (F.col("_hits") + 1) / F.lit(permutations + 1)).alias("p_value"),
        F.lit(permutations).alias("permutations"), "rule", used_seed.alias("seed"),
    )


def moran_local(values: DataFrame, edges: DataFrame, permutations: int = fv.PERMUTATIONS,
                seed: int = fv.PERMUTATION_SEED) -> DataFrame:
    """Local coefficient, unconditional permutation p and cluster label per area.

    The area's own value is dealt out too; the variance is that of the population.
    """
    values, edges = _complete(values), cut_lineage(edges.select("rule", "src", "dst", "weight"))
    variance = F.col("zz") / F.col("n")
    observed = spatial_lag(values, edges).withColumn(
        "local_i", F.try_divide(F.col("z") * F.col("lag"), variance)
    )
    limits = observed.select("rule", "year", "code", "local_i", variance.alias("_var"))

    def terms(rule, year, positions, dealt, lags):
        return zip([rule] * len(positions), [year] * len(positions), positions, dealt * lags)

    placed = _placed(values).select("year", "position", "code")
    hits = _with_lags(values, edges, permutations, seed, False, terms, "rule string, year long, position long, terms array<double>").join(
        placed, ["year", "position"]).join(limits, ["rule", "year", "code"]).select(
        "rule", "year", "code", F.size(F.filter("terms", lambda t: _extreme(F.try_divide(t, F.col("_var")), F.col("local_i")))).alias("_hits"))
    p_value = F.when(F.col("local_i").isNotNull(), (F.col("_hits") + 1) / F.lit(permutations + 1))
    return (
        observed.join(hits, ["rule", "year", "code"])
        .withColumn("p_value", p_value)
        .withColumn("cluster", significant(quadrant("z", "lag"), "p_value"))
        .select("code", "year", "value", "z", "lag", "local_i", "p_value", "cluster",
                F.lit(permutations).alias("permutations"), "rule")
    )
