"""Steps that happen once and as a whole: exclusive folders, and several tables moved together.

What is written goes to a hidden folder first.  One rename that refuses an
existing target then makes it visible, so of two writers the storage lets one
through.  That needs a file system with an atomic rename (HDFS, ABFS, a shared
disk); within this process a lock adds it where the file system's own check and
rename are two steps.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigipanel.operators import quality

_ONE_AT_A_TIME = threading.Lock()


def folder_of(key: str) -> str:
    """A folder name for any key; the letter keeps it text where Spark infers types of partition folders."""
    return "r" + hashlib.sha256(key.encode("utf-8")).hexdigest()[:32]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def renamed_once(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder or file to a name that must not exist; false where it does."""
    from py4j.protocol import Py4JJavaError

    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(_system(spark, target).getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    with _ONE_AT_A_TIME:
        try:
            context.rename(_path(spark, source), _path(spark, target), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                return False
            raise
    return True


def write_once(df: DataFrame, folder: str, column: str, key: str) -> bool:
    """Add ``df`` to the table at ``folder`` as its own partition ``column=<name of key>``; false where that key is stored already."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    staged = f"{folder}/.staging-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    if renamed_once(spark, staged, f"{folder}/{column}={folder_of(key)}"):
        return True
    _system(spark, staged).delete(_path(spark, staged), True)          # its own, never seen by a reader
    return False


# --- several tables at once -----------------------------------------------------


def current_version(spark: SparkSession, folder: str) -> int:
    """The highest version of the set, 0 where there is none."""
    where = f"{folder.rstrip('/')}/versions"
    system = _system(spark, where)
    if not system.exists(_path(spark, where)):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(_path(spark, where))]
    return max([int(n[1:]) for n in names if n[:1] == "v"], default=0)


def publish_set(frames: dict[str, DataFrame], folder: str, checks: list[DataFrame | Callable] = (), based_on: int | None = None) -> int:
    """Make new contents of several tables visible together; returns the version.

    All frames are written and all gates are run on what was written before the
    one step that counts: a pointer with the folders of all tables takes the next
    version number.  A failure at any point before leaves every name at the old
    version; tables not among ``frames`` keep their folders.  Where another writer
    has taken that number meanwhile, a ``QualityError`` says so.  A check is a
    frame of violations, or a function of the written frames to one.
    """
    if not frames:
        raise quality.QualityError("no tables to publish")
    spark, folder = next(iter(frames.values())).sparkSession, folder.rstrip("/")
    version = current_version(spark, folder) if based_on is None else based_on
    paths = dict(_pointer(spark, folder, version)) if version else {}
    for name, frame in frames.items():
        paths[name] = f"{folder}/data/{name}-{uuid.uuid4().hex}"
        frame.write.mode("errorifexists").parquet(paths[name])
    written = {name: spark.read.parquet(paths[name]) for name in frames}
    for check in checks:
        quality.enforce(check(written) if callable(check) else check)
    staged = f"{folder}/.pointer-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(paths),)], "value string").coalesce(1).write.mode("errorifexists").text(staged)
    _system(spark, folder).mkdirs(_path(spark, f"{folder}/versions"))
    if not renamed_once(spark, staged, f"{folder}/versions/v{version + 1}"):
        raise quality.QualityError(f"version {version + 1} was published by another writer; start again from it")
    return version + 1


def _pointer(spark: SparkSession, folder: str, version: int) -> dict[str, str]:
    return json.loads(spark.read.text(f"{folder.rstrip('/')}/versions/v{version}").first()[0])


def read_set(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, the current one if none is named."""
    version = version or current_version(spark, folder)
    return {name: spark.read.parquet(path) for name, path in _pointer(spark, folder, version).items()} if version else {}


def view_set(spark: SparkSession, folder: str, prefix: str = "", version: int | None = None) -> list[str]:
    """Temporary views of one version's tables; they stay with it until called again."""
    tables = read_set(spark, folder, version)
    for name, table in tables.items():
        table.createOrReplaceTempView(prefix + name)
    return sorted(prefix + name for name in tables)
