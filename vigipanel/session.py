"""Session helpers: a local session for tests and benches, and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "vigipanel", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    It is read from ``spark.checkpoint.dir`` or the checkpoint directory of the
    context.  Where neither is set, a local master gets a fresh local folder;
    any other master must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="vigipanel-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one written table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write a frame that several branches read to the shared folder, and read it back.

    Unlike an in-memory or local copy it survives lost executors; unlike an RDD
    checkpoint it is computed once, stays columnar, and gives the optimizer true
    sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
