"""Lines and records of delimited text files of any size.

Files are read as Spark cuts them: a split is a block of lines, and no row ever
holds more than one line.  What belongs to a whole file is told from its blocks:

* the encoding: a file is UTF-8 if every line of it is (a line end is no part of
  a longer UTF-8 character, so lines can be judged alone);
* line numbers: lines before a block are a running total over the blocks;
* quotes: a line with an odd number of quotes opens or closes a quoted part.
  Whether a block begins inside one is the parity of such lines before it, so
  records that span lines, or blocks, are found from the numbers of odd lines.

A quote that is never closed opens a last record that goes on to the end of the
file for counting; its lines stay single where records are read.  A record over
several lines is put together with line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigipanel.session import cut_lineage

UTF8, LATIN1 = "utf-8-sig", "latin-1"
_IN_TASK = (1 << 33) - 1          # the part of a generated id that counts rows of one task


def raw_lines(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``path, block, row, value``: lines as bytes in a string column, whatever their encoding; ``row`` rises by one within a block."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # the path is percent-encoded; a plus sign is one
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return reader.text(root).select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)).alias("row"), "value",
    )


def _times(text: Column, character: str) -> Column:
    """How often an ASCII character occurs, in bytes of whatever encoding."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def _odd(value: str) -> Column:
    return _times(F.col(value), '"') % 2 == 1


def block_table(raw: DataFrame) -> DataFrame:
    """One row per block: its first row, lines and odd lines, those before it in the file, and whether it is UTF-8."""
    blocks = raw.groupBy("path", "block").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"), F.count_if(_odd("value")).alias("odd"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(blocks.select(
        "*", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("odd_before"),
    ))


def numbered(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with their number in the file, from 0, and the block's facts."""
    return raw.join(blocks, ["path", "block"]).withColumn("number", F.col("lines_before") + F.col("row") - F.col("first"))


def odd_lines(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """``path, block, number, rank``: lines with an odd number of quotes, counted from 1 in their file; sorted within blocks only."""
    odd = numbered(raw.where(_odd("value")), blocks.where("odd > 0"))
    rank = F.row_number().over(Window.partitionBy("path", "block").orderBy("row"))
    return odd.select("path", "block", "number", (F.col("odd_before") + rank).alias("rank"))


def _outside(value: Column, inside: Column) -> Column:
    """Commas of a line outside quotes, if it begins inside or outside of one."""
    parts = F.filter(F.split(value, '"'), lambda _, k: k % 2 == inside)
    return F.aggregate(parts, F.lit(0), lambda total, part: total + _times(part, ","))


def shapes(raw: DataFrame) -> DataFrame:
    """``path, rows, columns`` of files with at least one line: records but the header, and width of the header.

    A line break inside quotes ends no record; an empty header has no column.
    """
    blocks = block_table(raw)
    odd = cut_lineage(odd_lines(raw, blocks))
    sums = odd.groupBy("path").agg(
        F.sum(F.when(F.col("rank") % 2 == 0, F.col("number")).otherwise(-F.col("number"))).alias("within"),
        F.min(F.when(F.col("rank") == 1, F.col("number"))).alias("opens"), F.min(F.when(F.col("rank") == 2, F.col("number"))).alias("closes"),
    )
    files = blocks.groupBy("path").agg(F.sum("lines").alias("lines"), F.sum("odd").alias("odd")).join(sums, "path", "left")
    last = F.col("lines") - 1
    within = F.coalesce("within", F.lit(0)) + F.when(F.col("odd") % 2 == 1, last).otherwise(0)
    heads = cut_lineage(files.select(
        "path", (last - within).alias("rows"), F.when(F.col("opens") == 0, F.coalesce("closes", last)).otherwise(0).alias("head"),
    ))
    # only blocks that hold header lines are looked at again
    held = blocks.join(heads, "path").where("lines_before <= head")
    head = numbered(raw, held).where("number <= head")
    begun = F.when(F.col("number") == 0, 0).otherwise(1)
    text = F.when(F.col("number") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    widths = head.groupBy("path").agg(
        F.sum(_outside(text, begun)).alias("commas"), F.sum(F.octet_length(text)).alias("bytes"), F.count(F.lit(1)).alias("n"))
    width = F.when((F.col("bytes") == 0) & (F.col("n") == 1), 0).otherwise(F.col("commas") + 1)
    return heads.join(widths, "path").select("path", F.col("rows").cast("long").alias("rows"), width.cast("long").alias("columns"))


def records(raw: DataFrame) -> DataFrame:
    """``path, encoding, line_number, line``: decoded records that aren't empty, by the number of their first line."""
    blocks = block_table(raw)
    files = blocks.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.sum("odd").alias("odd_in_file"))
    known = cut_lineage(blocks.drop("utf8").join(files, "path"))
    quiet = (F.col("odd") == 0) & (F.col("odd_before") % 2 == 0)
    plain = numbered(raw, known.where(quiet)).withColumn("record", F.col("number"))
    # blocks with quoted line ends: which odd line opened the quote that a line begins in
    odd = cut_lineage(odd_lines(raw, blocks).groupBy("path", "block").agg(F.max("number").alias("last")))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = known.join(odd, ["path", "block"], "left").withColumn("opened_before", F.max("last").over(before)).where(~quiet)
    earlier = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lines = numbered(raw, cut_lineage(opened.drop("last"))).withColumn("is_odd", _odd("value"))
    lines = lines.withColumn("turns", F.col("odd_before") + F.coalesce(F.count_if("is_odd").over(earlier), F.lit(0))).withColumn(
        "opener", F.coalesce(F.max(F.when(F.col("is_odd"), F.col("number"))).over(earlier), "opened_before"))
    unclosed = (F.col("odd_in_file") % 2 == 1) & (F.col("turns") == F.col("odd_in_file"))
    quoted = lines.withColumn("record", F.when((F.col("turns") % 2 == 1) & ~unclosed, F.col("opener")).otherwise(F.col("number")))
    part = (F.col("turns") % 2 == 1) & ~unclosed | F.col("is_odd") & (F.col("turns") % 2 == 0)
    kept = ["path", "utf8", "record", "number", "value"]
    several = quoted.where(part).groupBy("path", "utf8", "record").agg(F.array_sort(F.collect_list(F.struct("number", _text()))).alias("parts"))
    whole = several.select("path", "utf8", "record", F.array_join(F.col("parts.text"), "\n").alias("text"))
    single = plain.select(*kept).unionByName(quoted.where(~part).select(*kept)).select("path", "utf8", "record", _text())
    first = F.when(F.col("record") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    return single.unionByName(whole).select(
        "path", F.when(F.col("utf8"), UTF8).otherwise(LATIN1).alias("encoding"), F.col("record").alias("line_number"), first.alias("line"),
    ).where("line <> ''")


def _text() -> Column:
    return F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("text")
