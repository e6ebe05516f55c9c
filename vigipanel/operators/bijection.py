"""Keyed permutations of 0 .. n - 1, computed position by position without a sort.

A Feistel network on two halves of sides a and b, with a b a little over n: in
turn one half is moved by a keyed function of the other, modulo its side, which
can be undone, so positions of the a b cells are dealt one to one.  A position
that lands beyond n walks on through the network until it is below n; as at most
a b - n cells lie beyond, so many steps are enough.  All numbers stay below 63
bits, so any engine with whole numbers can repeat it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# fixed values: two primes and the powers of two multipliers modulo the first
MERSENNE, PRIME = (1 << 31) - 1, 4294967291
ROUNDS = 12
FACTORS = [pow(48271, k + 1, MERSENNE) for k in range(2 * ROUNDS)]
TERMS = [pow(69621, k + 1, MERSENNE) for k in range(2 * ROUNDS)]


def _whole(value: Column, by: Column | int) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def sides(n: Column) -> Column:
    """The sides a <= b of the cells for n positions: of a from half the root to the root, the one with the fewest cells beyond n."""
    root = F.sqrt(n.cast("double"))
    tried = F.sequence(F.greatest(F.lit(2), F.ceil(root / 2)).cast("long"), F.greatest(F.lit(2), F.floor(root)).cast("long"))

    def cells(a: Column) -> Column:
        b = _whole(n + a - 1, a)
        return F.struct((a * b - n).alias("beyond"), (-a).alias("_a"), a.alias("a"), b.alias("b"))

    return F.array_min(F.transform(tried, cells))


def keys(seed: int, group: int, permutations: np.ndarray) -> np.ndarray:
    """A whole number that stands for each permutation."""
    start = (seed * 48271 + group * 69621 + permutations.astype(np.int64) * 16807) % MERSENNE
    return (start * start % PRIME * 1103515245 + permutations) % PRIME


def _through(place: np.ndarray, a: int, b: int, key: np.ndarray) -> np.ndarray:
    """The network once for each place; ``key`` is a column of keys or one key per place."""
    key = key.astype(np.uint64)
    half, sides = list(np.divmod(place, np.uint64(b))), (np.uint64(a), np.uint64(b))
    prime = np.uint64(PRIME)
    for r in range(ROUNDS):
        times = np.uint64(1) + (key * np.uint64(FACTORS[r]) + np.uint64(TERMS[r])) % np.uint64(PRIME - 1)
        plus = (key * np.uint64(FACTORS[r + ROUNDS]) + np.uint64(TERMS[r + ROUNDS])) % prime
        half[r % 2] = (half[r % 2] + (half[1 - r % 2] * times + plus) % prime) % sides[r % 2]
    return half[0] * np.uint64(b) + half[1]


def _back(place: np.ndarray, a: int, b: int, key: np.ndarray) -> np.ndarray:
    """The network once, undone."""
    key = key.astype(np.uint64)
    half, sides = list(np.divmod(place, np.uint64(b))), (np.uint64(a), np.uint64(b))
    prime = np.uint64(PRIME)
    for r in reversed(range(ROUNDS)):
        times = np.uint64(1) + (key * np.uint64(FACTORS[r]) + np.uint64(TERMS[r])) % np.uint64(PRIME - 1)
        plus = (key * np.uint64(FACTORS[r + ROUNDS]) + np.uint64(TERMS[r + ROUNDS])) % prime
        side = sides[r % 2]
        half[r % 2] = (half[r % 2] + side - (half[1 - r % 2] * times + plus) % prime % side) % side
    return half[0] * np.uint64(b) + half[1]


def _walked(step, positions: np.ndarray, n: int, a: int, b: int, key: np.ndarray) -> np.ndarray:
    place = np.broadcast_to(positions.astype(np.uint64), (len(key), len(positions)))
    place = step(place, a, b, key[:, None])
    while True:
        row, column = np.nonzero(place >= np.uint64(n))
        if not len(row):
            return place.astype(np.int64)
        place[row, column] = step(place[row, column], a, b, key[row])


def dealt(positions: np.ndarray, n: int, a: int, b: int, key: np.ndarray) -> np.ndarray:
    """Where each permutation (row) deals each position (column), of ``n`` positions in ``a`` times ``b`` cells."""
    return _walked(_through, positions, n, a, b, key)


def drawn(positions: np.ndarray, n: int, a: int, b: int, key: np.ndarray) -> np.ndarray:
    """From which position each permutation (row) deals to each position (column): ``dealt``, undone."""
    return _walked(_back, positions, n, a, b, key)
