"""File inventories: listing, hashes, shapes, newest files, delimited files of unknown encoding.

The tree is walked level by level in tasks, so neither a folder nor a file
passes through the driver.  As in any scan of Spark, names that begin with a dot
or an underscore are no files.  What has to be read is read in chunks or lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import text as tx
from vigipanel.session import cut_lineage
from vigipanel.sources.lines import raw_lines, records, shapes

_CHUNK = 1 << 23
_ENTRIES = 10_000         # of a folder, in one batch
_FOLDERS_PER_TASK = 32


def _root(spark: SparkSession, root: str) -> str:
    """The folder as a URI, without a slash at the end."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().toString().rstrip("/")


def _entries(top: str):
    """A function that lists folders, given below ``top``, each without what lies below it."""
    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(top)
        for batch in batches:
            for folder in batch["path"]:
                found = [f for f in system.get_file_info(fs.FileSelector(base + folder)) if f.base_name[:1] not in "._"]
                for k in range(0, len(found), _ENTRIES):
                    some = found[k:k + _ENTRIES]
                    yield pd.DataFrame({
                        "path": [f"{folder}/{f.base_name}" for f in some], "folder": [f.type == fs.FileType.Directory for f in some],
                        "length": [0 if f.size is None else f.size for f in some],
                        "millis": pd.array([None if f.mtime_ns is None else f.mtime_ns // 1_000_000 for f in some], dtype="Int64"),
                    })

    return run


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modificationTime`` of every file below the root, the empty ones as well.

    The folders of one level are spread over tasks, each of which lists its own;
    the next level is what they found.  One number per level reaches the driver.
    """
    run = _entries(_root(spark, root))
    level, found = spark.createDataFrame([("",)], "path string"), None
    folders = 1
    while folders:
        spread = level.repartition(-(-folders // _FOLDERS_PER_TASK), "path")
        entries = cut_lineage(spread.mapInPandas(run, "path string, folder boolean, length long, millis long"))
        files = entries.where("NOT folder")
        found = files if found is None else found.unionByName(files)
        level = entries.where("folder").select("path")
        folders = level.count()
    return found.select(F.substring("path", 2, 1 << 20).alias("path"), "length", F.timestamp_millis("millis").alias("modificationTime"))


def content_hashes(files: DataFrame) -> DataFrame:
    """``path, length, sha256`` of artefacts with their content."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _digests(top: str):
    """A function that adds the SHA-256 of files, given below ``top``, read in chunks where the task runs."""
    def run(batches):
        import hashlib

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(top)
        for batch in batches:
            out = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with system.open_input_stream(f"{base}/{path}") as stream:
                    while chunk := stream.read(_CHUNK):
                        digest.update(chunk)
                out.append(digest.hexdigest())
            yield batch.assign(sha256=out)

    return run


def hashed(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Files of a ``listing`` with ``sha256``, whatever their size."""
    kept = files.select("path", "length", "modificationTime")
    return kept.mapInPandas(_digests(_root(spark, root)), "path string, length long, modificationTime timestamp, sha256 string")


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, sha256`` of all files below the root."""
    return hashed(spark, root, listing(spark, root)).select("path", "length", "sha256")


def with_shape(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Files of a ``listing`` with data rows and header width of the CSV files among them; other files have neither.

    A line break inside quotes is no row end; an empty file has 0 rows and 0
    columns.
    """
    is_csv = F.lower("path").endswith(".csv")
    shaped = shapes(raw_lines(spark, root, "*.[cC][sS][vV]"))
    below = _below(spark, root, "path")
    held = files.join(shaped.select(below.alias("path"), "rows", "columns"), "path", "left")
    return held.withColumns({c: F.when(is_csv, F.coalesce(c, F.lit(0).cast("long"))) for c in ("rows", "columns")})


def _below(spark: SparkSession, root: str, path: str) -> Column:
    """A file's path below the root; schemes and hosts may be spelled in several ways."""
    top = spark._jvm.org.apache.hadoop.fs.Path(_root(spark, root)).toUri().getPath().rstrip("/") + "/"
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return F.when(bare.startswith(top), F.substring(bare, len(top) + 1, 1 << 20)).otherwise(F.col(path))


def file_control(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The control table of all files below ``root/<layer>/<domain>/``."""
    files = cut_lineage(hashed(spark, root, listing(spark, root)))
    layer = F.element_at(F.split("path", "/"), 1)
    domain = F.get(F.split("path", "/"), F.lit(1))
    stamp = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return with_shape(spark, root, files).select(
        F.col("path").alias("arquivo"), layer.alias("camada"), tx.source_of_path("path").alias("fonte"),
        stamp.alias("data_criacao"), stamp.alias("data_modificacao"),
        F.col("rows").alias("quantidade_linhas"), F.col("columns").alias("quantidade_colunas"), F.col("sha256").alias("hash_sha256"),
        F.when(layer == "raw", "").otherwise(F.concat(F.lit("raw/"), domain, F.lit("/"))).alias("arquivo_origem"),
        F.lit(fv.FILE_STATUS).alias("status_validacao"), F.lit(version).alias("versao_pipeline"),
    )


def newest(files: DataFrame, group) -> DataFrame:
    """The file with the latest modification per group, ties by path."""
    return files.withColumn("kind", group).groupBy("kind").agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
        F.max("modificationTime").alias("modificationTime"),
    )


def decoded_csv(spark: SparkSession, root: str, delimiter: str = ";", pattern: str | None = None) -> DataFrame:
    """Rows of delimited files in UTF-8 or, failing that, Latin-1; files of any size.

    Returns ``path, encoding, line_number, cells`` (all fields of a record as an
    array, quotes removed); line 0 is the header.  A record that spans lines has
    the number of its first one.
    """
    found = records(raw_lines(spark, root, pattern))
    outside = rf'{delimiter}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    unquoted = F.transform(
        F.split("line", outside),
        lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')),
    )
    return found.select(_below(spark, root, "path").alias("path"), "encoding", "line_number", unquoted.alias("cells"))


def population_series(lines: DataFrame, areas: DataFrame, years: list[int], source: str = "RIPSA/SES-RJ") -> DataFrame:
    """Wide population files (``code name`` first, one column per year) as a long series.

    Header and rows of a file meet by (path, column), so the year columns may
    stand anywhere.  Missing or non-positive values are for ``quality.sign``.
    """
    header = lines.where(F.col("line_number") == 0).select(
        "path", F.posexplode("cells").alias("_col", "_year_text")
    ).withColumn("year", F.trim("_year_text").try_cast("int")).where(F.col("year").isin(*years))
    body = lines.where(F.col("line_number") > 0)
    label = F.trim(F.get("cells", F.lit(0)))
    rows = body.select(
        "path", "encoding", tx.leading_code(label).alias("code6"), tx.name_after_code(label).alias("area_name"), "cells"
    )
    short = areas.select(F.left("code", F.lit(6)).alias("code6"), "code")
    return (
        rows.join(short, "code6").join(header.select("path", "_col", "year"), "path")
        .select(
            "code", "area_name", "year",
            F.trim(F.get("cells", F.col("_col"))).try_cast("bigint").alias("population"),
            F.lit(source).alias("source"), F.col("encoding").alias("source_encoding"),
        )
    )
