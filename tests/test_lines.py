"""Lines, records and shapes of files cut into small splits, against plain versions; listings of trees."""

import csv
import hashlib
import io
import random

import pytest

from vigipanel.sources import files
from vigipanel.sources.lines import raw_lines, records, shapes


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plain_records(text):
    """Line ends outside quotes end records; the tail behind a quote that is never closed is cut into lines."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    out, held, start = [], [], 0
    for k, line in enumerate(lines):
        if not held:
            start = k
        held.append(line)
        if sum(x.count('"') for x in held) % 2 == 0:
            out.append((start, "\n".join(held)))
            held = []
    open_tail = [(start + k, x) for k, x in enumerate(held)]
    return out, open_tail


def random_table(draw, n, letters):
    def field():
        body = "".join(draw.choice(letters) for _ in range(draw.randint(0, 12)))
        return '"' + body.replace('"', '""') + '"' if draw.random() < 0.4 else body.translate({ord(c): None for c in '",\n\r'})

    return "".join(",".join(field() for _ in range(draw.randint(1, 4))) + draw.choice(["\n", "\n", "\r\n"]) for _ in range(n))


@pytest.fixture()
def tree(tmp_path):
    draw = random.Random(21)
    made = {}
    for k in range(14):
        text = random_table(draw, draw.randint(1, 40), 'ab,"é\n\r ')
        if k % 3 == 0:
            text = text.rstrip("\r\n")
        made[f"d{k % 3}/f {k}+%.csv"] = ("﻿" if k % 4 == 1 and k % 3 < 2 else "") + text
    made["d0/wide.csv"] = '"a\nb",c\n' + 'x,"' + "long é line\n" * 40 + '",y\n1,2,3\n'          # a record over many splits
    made["d0/head.csv"] = '"' + "title\n" * 30 + '",b,"c,d"\n1,2,3\n'                             # and a header
    made["d1/open.csv"] = 'a,b\n1,"never\nclosed\nat all\n'
    made["d1/blank.csv"] = "\n\nx\n"
    made["d2/none.CSV"] = ""
    for name, text in made.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode("latin-1" if "d2" in name else "utf-8"))
    return made


def test_records_across_splits(spark, tmp_path, tree, small_splits):
    raw = raw_lines(spark, str(tmp_path), "*.csv")
    assert raw.rdd.getNumPartitions() > 20
    got = {}
    for r in records(raw).collect():
        got.setdefault(r["path"].split(str(tmp_path) + "/")[1], []).append((r["line_number"], r["line"], r["encoding"]))
    for name, text in tree.items():
        latin = "d2" in name and not text.isascii()
        whole, tail = plain_records(text.removeprefix("﻿") if not latin else text.encode("latin-1", "replace").decode("latin-1"))
        assert sorted(got.get(name, [])) == [(k, x, "latin-1" if latin else "utf-8-sig") for k, x in whole + tail if x], name


def test_shapes_across_splits(spark, tmp_path, tree, small_splits):
    got = {r["path"].split(str(tmp_path) + "/")[1]: (r["rows"], r["columns"]) for r in shapes(raw_lines(spark, str(tmp_path), "*.csv")).collect()}
    for name, text in tree.items():
        if not text:
            continue
        whole, tail = plain_records(text.removeprefix("﻿"))
        n = len(whole) + bool(tail)
        head = whole[0][1] if whole else "\n".join(x for _, x in tail)
        width = len(next(csv.reader(io.StringIO(head), strict=False), [])) if head.count('"') % 2 == 0 and '""' not in head else sum(p.count(",") for p in head.split('"')[::2]) + 1
        assert got[name] == (n - 1, 0 if head == "" else width), name


def test_tree_listing(spark, tmp_path, tree):
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.csv").write_text("a\n")
    (tmp_path / ".gitkeep").write_text("")
    (tmp_path / "d0" / "empty folder").mkdir()
    deep = tmp_path / "d0" / "e" / "f" / "g"
    deep.mkdir(parents=True)
    (deep / "h.bin").write_bytes(b"\x00" * 7)
    want = {str(p.relative_to(tmp_path)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_mtime_ns // 1_000_000)
            for p in tmp_path.rglob("*") if p.is_file() and "_hidden" not in str(p) and p.name != ".gitkeep"}
    rows = files.hashed(spark, str(tmp_path), files.listing(spark, str(tmp_path))).selectExpr("path", "length", "sha256", "unix_millis(modificationTime) AS m").collect()
    assert {r["path"]: (r["length"], r["sha256"], r["m"]) for r in rows} == want and "d2/none.CSV" in want
    control = {r["arquivo"]: r for r in files.file_control(spark, str(tmp_path), "1").collect()}
    assert set(control) == set(want)
    assert (control["d2/none.CSV"]["quantidade_linhas"], control["d2/none.CSV"]["quantidade_colunas"]) == (0, 0)
    assert (control["d0/wide.csv"]["quantidade_linhas"], control["d0/wide.csv"]["quantidade_colunas"]) == (2, 2)
    assert control["d0/e/f/g/h.bin"]["quantidade_linhas"] is None
