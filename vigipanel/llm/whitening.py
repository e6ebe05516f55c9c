"""Principal components and whitened coordinates of vectors, without a matrix of their covariance.

Entries become whole numbers x = floor(256 c).  The fit list holds each distinct
x once.  Its covariance V (divisor n) is only ever applied: one pass over the
fit list gives V times a block of vectors, as the sum of (x - S/n) ((x - S/n) . p)
over the rows, added up inside tasks in extended precision and then by a
shuffle on the dimension.  Neither V nor any row reaches the driver; it holds a
subspace of at most ``WIDEST`` vectors.

Jacobi-Davidson finds the leading eigenvectors: Rayleigh-Ritz in the subspace,
then for every Ritz pair that has not converged a correction t from

    (I - Z Z') (V - theta I) (I - Z Z') t = -(V u - theta u),    Z = locked vectors and Ritz vectors,

solved by a few steps of MINRES, all corrections side by side, so a step is one
pass.  A pair whose residual is down to rounding (``d`` units in the last place
of the largest eigenvalue, 64 at least) is locked, in falling order; the subspace is cut back
to its best Ritz vectors when it is full.

Edge cases: a null vector, or one with a null or non-finite entry, gives no row.
A shorter vector counts as padded with zeros to the longest.  Repeated rows are
one member of the fit list but each gives its rows; a null vec_id stays null.
Components without variance (eigenvalue down to rounding) are left out, as are
those beyond the dimensions; with one distinct vector, or an empty table, there
are none and the result is empty.  Eigenvectors of equal eigenvalues are some
basis of their space.  ``deviation`` is exact; it is null where it doesn't fit
64 bits.  Signs are chosen so that the entry of largest size is positive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigipanel.session import cut_lineage

COMPONENTS = 4
SCALE = 256
WIDEST = 48
GUARDS = 12              # further Ritz vectors that are corrected in the same passes
STEPS = 6                # of MINRES for one correction, at most
TOLERANCE = 0.5          # of the first correction; each further one is solved that much better
PATIENCE, ROUNDING = 8, 1e-12
ROWS_AT_ONCE = 256       # rows of one plain product, before extended precision takes over
_EPS = float(np.finfo(float).eps)


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that count, as whole numbers."""
    entries = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return table.where(fine).select("vec_id", F.transform(entries, lambda c: F.floor(c * SCALE)).alias("x"))


def _padded(column: pd.Series, d: int) -> np.ndarray:
    lengths = column.str.len().to_numpy()
    if (lengths == d).all():
        return np.concatenate(column.to_numpy()).reshape(len(column), d)
    out = np.zeros((len(column), d), np.int64)
    for k, row in enumerate(column):
        out[k, :len(row)] = row
    return out


@dataclass
class Fit:
    """The fit list and what is known of it: rows, sums per dimension, the trace of the covariance."""

    rows: DataFrame
    n: int
    sums: list[int]
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])          # Python divides integers of any size rightly

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over the fit list, divided by n, of ``of`` (centred rows to one matrix of ``shape``)."""
        mean, d = self.mean, len(self.sums)

        def partial(batches):
            held = np.zeros(shape, np.longdouble)
            for batch in batches:
                x = _padded(batch["x"], d) - mean
                for k in range(0, len(x), ROWS_AT_ONCE):
                    held += of(x[k:k + ROWS_AT_ONCE])
            yield pd.DataFrame({"at": np.arange(shape[0], dtype=np.int32), "part": list(held.astype(float))})

        parts = self.rows.select("x").mapInPandas(partial, "at int, part array<double>")
        summed = parts.groupBy("at").agg(*[F.sum(F.col("part")[k]).alias(f"p{k}") for k in range(shape[1])]).toPandas()     # one row per row of ``shape``
        self.passes += 1
        out = np.zeros(shape)
        out[summed["at"].to_numpy()] = summed.drop(columns="at").to_numpy(float)
        return out / self.n

    def product(self, p: np.ndarray) -> np.ndarray:
        """V p for the columns of p."""
        return self.total(lambda x: x.T @ (x @ p), p.shape)


def fit_list(vectors: DataFrame) -> Fit:
    """Each distinct x once, written; sums by dimension as exact decimals."""
    longest = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if not longest:
        return Fit(vectors, 0, [])
    zero = F.lit(0).cast("long")
    padded = F.when(F.size("x") == longest, F.col("x")).otherwise(F.slice(F.concat("x", F.array_repeat(zero, longest)), 1, longest))
    rows = cut_lineage(vectors.select(padded.alias("x")).distinct())

    def partial(batches):
        high, low, n = np.zeros(longest, np.int64), np.zeros(longest, np.int64), 0
        for batch in batches:
            x = _padded(batch["x"], longest)
            high += (x >> 32).sum(axis=0)          # halves of 32 bits: 2**31 rows of a task fit
            low += (x & 0xFFFFFFFF).sum(axis=0)
            n += len(x)
        yield pd.DataFrame({"at": np.arange(-1, longest, dtype=np.int32), "high": [0, *high.tolist()], "low": [n, *low.tolist()]})

    sums = rows.mapInPandas(partial, "at int, high long, low long").groupBy("at").agg(
        F.sum(F.col("high").cast("decimal(38,0)") * (1 << 32) + F.col("low")).alias("s")).collect()     # one row per dimension
    by_place = {r["at"]: int(r["s"]) for r in sums}
    return Fit(rows, by_place.get(-1, 0), [by_place[k] for k in range(longest)] if by_place else [])


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """``new`` made orthonormal and orthogonal to ``against``, twice over; columns that vanish are dropped."""
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            for basis in (*against, out):
                v = v - basis @ (basis.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * size > 0:
            v = v / left
            for basis in (*against, out):
                v = v - basis @ (basis.T @ v)
            out = np.column_stack((out, v / np.linalg.norm(v)))
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Minimal residual solutions of symmetric systems, one per column; a column that is solved stands still."""
    width = right.shape[1]
    solution, beta = np.zeros_like(right), np.linalg.norm(right, axis=0)
    stop = beta * tolerance
    before, now = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    w_before, w = np.zeros_like(right), np.zeros_like(right)
    cos_before, cos, sin_before, sin = np.ones(width), np.ones(width), np.zeros(width), np.zeros(width)
    rest, beta = beta.copy(), np.zeros(width)
    for _ in range(steps):
        open_ = np.abs(rest) > stop
        if not open_.any():
            break
        z = apply(now)
        alpha = (now * z).sum(axis=0)
        z = z - alpha * now - beta * before
        after = np.linalg.norm(z, axis=0)
        # the new column of the tridiagonal matrix under the last two rotations
        far = sin_before * beta
        mid = cos_before * beta
        near = cos * mid + sin * alpha
        here = -sin * mid + cos * alpha
        size = np.hypot(here, after)
        alive = open_ & (size > 0)
        safe = np.where(alive, size, 1)
        w_new = (now - far * w_before - near * w) / safe
        cos_before, sin_before = cos, sin
        cos, sin = np.where(alive, here / safe, 1), np.where(alive, after / safe, 0)
        solution += np.where(alive, cos * rest, 0) * w_new
        rest = np.where(alive, -sin * rest, 0)
        w_before, w = w, w_new
        before, now, beta = now, z / np.where(after > 0, after, 1), after
    return solution


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors of the symmetric operator ``product``."""
    wanted = min(wanted, d)
    space = _orthonormal(np.random.default_rng(1).standard_normal((d, min(d, wanted + GUARDS))))
    image = product(space)
    locked, values, least, still, tolerance = np.zeros((d, 0)), [], np.inf, 0, TOLERANCE
    while True:
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        open_ = min(wanted + GUARDS - len(values), len(theta))
        ritz = space @ turn[:, :open_]
        residual = image @ turn[:, :open_] - ritz * theta[:open_]
        residual -= locked @ (locked.T @ residual)
        largest = max([*values, *np.abs(theta[:1])])
        sizes = np.linalg.norm(residual, axis=0)
        # rounding of the passes may lie above the aim: then the first pair is done once it stops falling
        still = 0 if sizes[0] < least / 2 else still + 1
        least = min(least, sizes[0])
        done = sizes <= max(d, 64) * _EPS * largest
        done[wanted - len(values):] = False       # guards are corrected, never locked
        done[0] |= still >= PATIENCE and sizes[0] <= ROUNDING * largest
        n_done = int(np.argmin(done)) if not done.all() else len(done)
        if space.shape[1] + len(values) == d:
            n_done = wanted - len(values)        # the subspace is the whole space: nothing is left to correct
        values += theta[:n_done].tolist()
        locked = np.column_stack((locked, _orthonormal(ritz[:, :n_done], locked)))
        if n_done:
            least, still = np.inf, 0
        if len(values) == wanted:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        keep = min(wanted + GUARDS, turn.shape[1]) if space.shape[1] + open_ > WIDEST else turn.shape[1]
        space, image = space @ turn[:, n_done:keep], image @ turn[:, n_done:keep]
        ritz, residual, shift = ritz[:, n_done:], residual[:, n_done:], theta[n_done:open_]
        off = np.column_stack((locked, ritz))

        def projected(p: np.ndarray) -> np.ndarray:
            p = p - off @ (off.T @ p)
            p = product(p) - shift * p
            return p - off @ (off.T @ p)

        right = -(residual - off @ (off.T @ residual))
        size = np.linalg.norm(right, axis=0)
        new = _orthonormal(minres(projected, right / np.where(size > 0, size, 1), STEPS, tolerance), locked, space)
        tolerance = max(tolerance * TOLERANCE, 1e-4)
        if not new.shape[1]:                     # corrections lie in the subspace already: widen it at random
            new = _orthonormal(np.random.default_rng(len(values) + 2).standard_normal((d, 1)), locked, space)
        space, image = np.column_stack((space, new)), np.column_stack((image, product(new)))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of squares of n x - S, exact; null beyond 64 bits."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if bound * bound * len(sums) < 1 << 63:
        gap = x * n - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per row that counts and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = whole_vectors(table)
    fit = fit_list(vectors)
    d, n, sums = len(fit.sums), fit.n, fit.sums
    if n < 2 or not d:
        return table.sparkSession.createDataFrame([], schema)
    trace = float(fit.total(lambda x: (x * x).sum(axis=0)[:, None], (d, 1)).sum())
    values, axes = eigenpairs(fit.product, d, components)
    some = values > d * _EPS * trace
    values, axes = values[some], axes[:, some]
    if not len(values):
        return table.sparkSession.createDataFrame([], schema)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    scaled, mean, count = axes / np.sqrt(values), fit.mean, len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ scaled
        return np.column_stack((w.T @ w, w.sum(axis=0)))

    found = fit.total(moments, (count, count + 1))
    covariance = found[:, :count] - np.outer(found[:, count], found[:, count])          # the means are rounding only
    error = float(np.abs(covariance - np.eye(count)).max())

    def rows(batches):
        for batch in batches:
            x = _padded(batch["x"], d)
            w = (x - mean) @ scaled
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].astype("Int64").repeat(count), "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), "n": n,
                "deviation": pd.array(_deviations(x, n, sums), dtype="Int64").repeat(count), "whitened": w.ravel(),
                "explained": np.tile(values / trace, len(x)), "identity_error": error,
            })

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInPandas(rows, schema)
