"""Exclusive folders and sets of tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from vigipanel.operators import quality as dq
from vigipanel.sinks import lookup, tables as sinks, versions


def test_one_of_two_writers(spark, tmp_path):
    """Eight writers of one key at once: one gets through, its rows are there once, and nothing else is left."""
    folder = str(tmp_path / "t")
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda k: versions.write_once(spark.createDataFrame([(k, "x")], "k int, v string"), folder, "key", "run 1/ã"), range(8)))
    assert sum(done) == 1
    assert [r["k"] for r in spark.read.parquet(folder).collect()] == [done.index(True)]
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.endswith(".crc")] == ["key=" + versions.folder_of("run 1/ã")]
    assert versions.write_once(spark.createDataFrame([(9, "y")], "k int, v string"), folder, "key", "run 2") and spark.read.parquet(folder).count() == 2


def test_versions_inserted_once(spark, tmp_path):
    folder = str(tmp_path / "version")
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda _: sinks.insert_version(spark, folder, "0.1.0"), range(4))) == [False, False, False, True]
    assert sinks.insert_version(spark, folder, "0.2.0")
    assert sorted(r["version"] for r in spark.read.parquet(folder).collect()) == ["0.1.0", "0.2.0"]


def test_set_of_tables(spark, tmp_path):
    folder = str(tmp_path / "set")

    def table(*rows):
        return spark.createDataFrame(list(rows), "k int, v string")

    assert versions.read_set(spark, folder) == {} and versions.current_version(spark, folder) == 0
    assert versions.publish_set({"a": table((1, "x")), "b": table((1, "y"))}, folder) == 1
    # the gate of b fails after a was written: neither name moves
    with pytest.raises(dq.QualityError):
        versions.publish_set({"a": table((2, "x")), "b": table((2, "y"), (2, "y"))}, folder, [lambda t: dq.unique_key(t["b"], ["k"])])
    # a write that fails between the two tables
    broken = table((3, "y")).selectExpr("raise_error('broken') AS k", "v")
    with pytest.raises(Exception, match="broken"):
        versions.publish_set({"a": table((3, "x")), "b": broken}, folder)
    held = {n: [tuple(r) for r in t.collect()] for n, t in versions.read_set(spark, folder).items()}
    assert held == {"a": [(1, "x")], "b": [(1, "y")]} and versions.current_version(spark, folder) == 1
    # a part of the set: the other table keeps its folder
    assert versions.publish_set({"b": table((4, "z"))}, folder) == 2
    assert versions.view_set(spark, folder, "set_") == ["set_a", "set_b"]
    assert spark.sql("SELECT a.k, b.k FROM set_a a, set_b b").collect() == [(1, 4)]
    assert [tuple(r) for r in versions.read_set(spark, folder, 1)["b"].collect()] == [(1, "y")]
    # a writer that began from version 1 is refused
    with pytest.raises(dq.QualityError, match="another writer"):
        versions.publish_set({"a": table((5, "x"))}, folder, based_on=1)
    with pytest.raises(dq.QualityError):
        versions.publish_set({}, folder)


def _rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lookups_read_few_row_groups(spark, tmp_path):
    """100,000 rows in row groups of 1,000: a sorted key meets one group, a scattered one those that hold it, an absent one none."""
    path = str(tmp_path / "t")
    rows = spark.range(100_000).selectExpr("id", "concat('a', lpad(id div 20, 6, '0')) AS code", "pmod(xxhash64(id), 1000003) AS other")
    lookup.write_lookup(rows, path, ["code", "id"], ["other"], rows_per_group=1000, files=4)
    held = spark.read.parquet(path)
    code = held.where("code = 'a001234'")
    assert code.count() == 20 and _rows_scanned(code) <= 2000
    span = held.where("code >= 'a001000' AND code < 'a001100'")
    assert span.count() == 2000 and _rows_scanned(span) <= 4000
    wanted = rows.where("id = 777").first()["other"]
    scattered = held.where(f"other = {wanted}")
    n = scattered.count()
    assert n >= 1 and _rows_scanned(scattered) <= 1000 * (n + 5)
    absent = held.where("code = 'a001234x'")
    assert absent.count() == 0 and _rows_scanned(absent) <= 1000
