"""The driver contract and a slice of the registered queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL

SLICE = ["annual_incidence", "annual_incidence_sparse", "weekly_series", "duplicate_providers", "survey_panel", "dq_years", "knn4_points"]


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert rows and {r["area_criterion"] for r in rows} == {"ID_MN_RESI"}


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 100


@pytest.mark.parametrize("name", SLICE)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    names = [d[0] for d in result.description]
    right = sorted((str([r[names.index(c)] for c in columns]) for r in result.fetchall()))
    df = contract.queries()[name](spark, SMALL)
    assert sorted(df.columns) == columns
    left = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert left == right and not any("nan" in r for r in left)
