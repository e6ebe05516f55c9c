"""Joins on group keys of which any may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def same_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` in which a null key equals a null key."""
    own = {k: f"_key_{k}" for k in keys}
    renamed = right.select(*[F.col(c).alias(own.get(c, c)) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()])
    return left.join(renamed, same, how).drop(*own.values())
