"""Column functions: each returns a built-in expression, none a Python UDF."""

from pyspark.sql import Column, functions as F


def as_col(value) -> Column:
    """A name or a column as a column."""
    return F.col(value) if isinstance(value, str) else value
