"""Tables laid out for lookups: what an index does, done by order, statistics and Bloom filters.

Rows go to files by ranges of the leading keys and are sorted inside them, so the
smallest and largest value of a row group and of each page rule out all but a
few for an equality or a range of leading keys.  Further keys, whose values are
scattered over the files, get a Bloom filter per row group.  Readers do nothing
special: the filters of an ordinary query reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_PER_GROUP = 1_000_000


def write_lookup(df: DataFrame, path: str, sorted_by: list[str], also_by: list[str] = (), rows_per_group: int = ROWS_PER_GROUP, files: int | None = None) -> None:
    """Write ``df`` for lookups by ``sorted_by`` (leading keys first) and by any of ``also_by``.

    The number of files follows the shuffle settings unless it is given.  One key
    with very many rows may fill several row groups of one file; they are still
    read alone.
    """
    ranged = df.repartitionByRange(files, *sorted_by) if files else df.repartitionByRange(*sorted_by)
    writer = ranged.sortWithinPartitions(*sorted_by).write.mode("errorifexists").option("parquet.block.row.count.limit", rows_per_group)
    for key in also_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", rows_per_group)
    writer.parquet(path)
