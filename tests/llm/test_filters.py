"""Quality rules, URL rules and licence scans against SQL and hand-made cases."""

import duckdb
import pytest

from tests.conftest import SMALL
from tests.llm.conftest import frame
from vigipanel.llm import license_index, quality_rules, queries, url_rules


def _sql(name, tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(f"_{table}", rows)
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM _{table}")
    result = con.execute(queries.COMPARISON[name])
    columns = [d[0] for d in result.description]
    order = sorted(columns)
    return order, sorted(str([r[columns.index(c)] for c in order]) for r in result.fetchall())


def _same(df, name, tables):
    order, right = _sql(name, tables)
    assert sorted(df.columns) == order
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == right


TEXTS = [
    None, "", "   \n\t ", "one two three", "the the the the the the the the the the the the",
    "a b c d e f g h i j k l a b c d e", "line one here now\nline one here now\nother words follow in this line today",
    "WE SHOUT AND SHOUT AND SHOUT SO MUCH MORE THAN ANYONE ELSE", "x" * 30000 + " " + " ".join(f"w{k}" for k in range(5000)),
    "un été où l’on va à la plage avec des amis très gentils demain matin",
]


def test_quality_counts(spark):
    import pandas as pd

    docs = frame(spark, TEXTS + TEXTS[3:5], 0)
    table = pd.DataFrame([{"doc_id": r["doc_id"], "text": r["text"]} for r in docs.collect()])
    _same(quality_rules.judged(docs).drop("text"), "op3_quality_rules", {"documents": table})
    assert quality_rules.judged(docs.where("false")).count() == 0


def test_order_changes_nothing(spark):
    docs = frame(spark, TEXTS)
    names = list(quality_rules.RULES)
    one = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, order=names).collect()}
    two = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, order=names[::-1]).collect()}
    assert one == two and set(quality_rules.measured_order(docs)) == set(names)


URLS = [
    None, "", "no scheme.com/x", "http://a.com/x?y#z", "https://WWW.Example.com/en/1", "http://example.com/en/", "http://sub.example.com/en/x",
    "http://example.com", "http://x.net/es/a", "http://x.net/fr/?q", "http://net/es/", "http://xnet/es/", "http://example.com/EN/", "ftp://u:p@h.net:8/es/b#f/",
    "http://a.b.c.d.e.f.example.com/en/" + "p/" * 2000, "http://x.com?a=/en/", "a://b://c.com/", "http://x.net/es/a",
]


def test_url_rules(spark):
    import pandas as pd

    rows = [(k, u, "<html>", "host", "rule") for k, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    _same(url_rules.judged(pages, rules), "op5_url_filters", {"pages": pd.DataFrame([(r[0], r[1]) for r in rows], columns=["page_id", "url"])})
    assert {r["verdict"] for r in url_rules.judged(pages, rules.where("false")).collect()} == {"allow"}
    assert url_rules.judged(pages.where("false"), rules).count() == 0


LICENCES = [
    None, "", "All rights reserved.", "Licensed under CC BY-NC 4.0.\ncc by", "CC cc by by", "This work is licensed under the GNU General Public License, version 3.",
    "general public licenses", "Licensed under the Apache License, Version 2.0. " * 3, "Released under the MIT License.", "accby", "écc by", "cc\u212a by",
    "filler " * 30000 + "all rights\nreserved",
]


def test_licences(spark):
    import pandas as pd

    docs = frame(spark, LICENCES + LICENCES[2:4])
    table = pd.DataFrame([{"doc_id": r["doc_id"], "text": r["text"]} for r in docs.collect()])
    out = license_index.scanned(docs)
    _same(out, "op10_license_scans", {"documents": table})
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[3]["base_labels"] == "cc-by" and by_id[3]["labels"] == "cc-by,cc-by-nc" and by_id[3]["n_base"] == 2
    assert by_id[5]["labels"] == "gpl,gpl-3.0" and by_id[7]["labels"] == "apache-2.0" and by_id[9]["n_base"] == 0
    assert license_index.scanned(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_url_filters", "op10_license_scans"])
def test_same_as_sql(spark, name):
    import pandas as pd

    tables = {t: pd.read_parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages")}
    _same(queries.QUERIES[name](spark, SMALL), name, tables)
