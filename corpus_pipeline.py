"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, benchmark leaks, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents, whatever their names.  A row is known by its doc_id and
text together, so texts that share a doc_id, or have none, are judged one by one;
rows that repeat both stay or go together.  Null, empty and blank texts are no
one's copy and hold no item: they pass every stage.  Of several copies the one
with the least doc_id stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigipanel.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from vigipanel.llm.bound import text_batches
from vigipanel.session import cut_lineage

REJECT_FROM = 0.5


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below ``REJECT_FROM``; the model is fitted on the labelled ones among ``docs``."""
    text_batches(spark)
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model)("text") < REJECT_FROM)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has already."""
    text_batches(spark)
    return line_dedup.deduplicated(docs)


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _named(docs: DataFrame) -> DataFrame:
    """The texts under the names of their rows, for operators that take ids."""
    return docs.select(_row().alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose names are in ``gone(row)``; the names are broadcast only where they are few."""
    gone = cut_lineage(gone)
    hint = F.broadcast(gone) if gone.count() <= jaccard_join.BROADCAST_IDS else gone
    held = docs.select(F.struct("*").alias("doc"), _row().alias("row")).join(hint, "row", "left_anti")
    return held.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component, and all that are alone."""
    text_batches(spark)
    found = jaccard_join.joined(_named(docs)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    ids = docs.select(_row().alias("row"), "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    members = cut_lineage(found.join(ids, "row").select("row", "component", order.alias("place")))
    first = members.groupBy("component").agg(F.min("place.row").alias("low"), F.max("place.row").alias("high"), F.min("place").alias("first")).where("low < high")
    gone = members.join(first.select("component", "first"), "component").where(F.col("row") != F.col("first.row")).select("row")
    return _without(docs, gone)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    text_batches(spark)
    leaks = decontamination.contaminated(_named(docs), _table(spark, sf_dir, "benchmark"))
    return _without(docs, leaks.select(F.col("doc_id").alias("row")).distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each remaining document goes into the mixture."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


ORACLE_SQL = None      # scores, edit distances and set joins are beyond SQL; tests compare with plain versions
