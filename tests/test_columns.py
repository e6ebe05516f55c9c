"""Column functions against hand-written literals."""

import datetime as dt
import math

from pyspark.sql import functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import indicators as ind, records as rec, text as tx, values as val


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


def test_normalise_name(spark):
    assert one(spark, "  São   Gonçalo ", tx.normalise_name("v")) == "SAO GONCALO"
    assert one(spark, "Œuvre ﬁ ½ Ĳssel", tx.unaccent("v")) is not None
    assert one(spark, "Ĳssel", tx.unaccent("v")) == "IJssel"
    assert one(spark, "été", tx.unaccent("v")) == "ete"
    assert one(spark, "   ", tx.normalise_name("v")) is None


def test_statuses(spark):
    rows = [("42.5",), ("Não Calc.- Div/0",), (None,), ("3,75",), ("1d",)]
    df = spark.createDataFrame(rows, "v string").withColumn("n", val.decimal_comma("v"))
    got = [(r["n"], r["s"]) for r in df.withColumn("s", val.value_status("v", "n")).collect()]
    assert got == [
        (42.5, "observado"), (None, "Não Calc.- Div/0"), (None, "ausente"), (3.75, "observado"), (None, "1d"),
    ]


def test_survey_status(spark):
    rows = [(1.0, "Ofício"), (None, "OFÍCIO com justificativa"), (None, "Oficio"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "m double, p string")
    assert [r[0] for r in df.select(val.survey_status("m", "p")).collect()] == [
        "observado", "justificativa", "justificativa", "nao_informado", "nao_informado"
    ]
    flags = spark.createDataFrame([(204.6,), (100.0,), (None,)], "v double").select(val.above("v")).collect()
    assert [r[0] for r in flags] == [True, False, False]


def test_classes(spark):
    df = spark.createDataFrame([("5",), ("10",), ("8",), ("0",), (None,)], "c string")
    rows = df.select(rec.probable("c"), rec.discarded("c"), rec.class_label("c")).collect()
    assert sum(r[0] for r in rows) == 4 and sum(r[1] for r in rows) == 1
    assert rows[2][2] == rows[4][2] == fv.UNLABELLED_CLASS


def test_dates_and_delays(spark):
    day = dt.date(2020, 2, 13)
    for text in ("20200213", "2020-02-13", "2020-02-13 00:00:00", "02/13/2020", "13/02/2020", " 2020-02-13 "):
        assert one(spark, text, rec.parse_mixed_date("v")) == day
    assert one(spark, "sem data", rec.parse_mixed_date("v")) is None
    df = spark.createDataFrame([(day, dt.date(2020, 2, 15)), (day, dt.date(2020, 2, 12))], "s date, n date")
    assert [tuple(r) for r in df.select(rec.delay_days("s", "n"), rec.masked_delay_days("s", "n")).collect()] == [(2, 2), (-1, None)]


def test_weeks(spark):
    assert one(spark, dt.date(1995, 1, 1), rec.iso_week_text("v"), "date") == "199452"
    df = spark.createDataFrame([("202001",), ("202054",), ("x",), (None,)], "w string")
    assert [r[0] for r in df.select(rec.valid_week("w", 2020, 2024)).collect()] == [True, False, None, None]


def test_codes(spark):
    assert one(spark, "GTA0001 + GTA0002 + GTA0001", tx.joined_codes("v")) == "GTA0001|GTA0002"
    cases = {
        "Não identificado": fv.CORRESPONDENCE_NONE, "GTA0001 + GTA0002": fv.CORRESPONDENCE_COMPOSED,
        "GTA0001 - 1": fv.CORRESPONDENCE_COMPOSED, "GTA0001": fv.CORRESPONDENCE_DIRECT, "ver nota": fv.CORRESPONDENCE_MANUAL,
    }
    for text, expected in cases.items():
        assert one(spark, text, tx.correspondence_class("v")) == expected
    assert one(spark, "330010 Angra dos Reis", tx.leading_code("v")) == "330010"
    assert one(spark, "330010 Angra dos Reis", tx.name_after_code("v")) == "Angra dos Reis"
    for code, good in {"3300100": True, "330010": False, "3500100": False, " 3300100 ": True}.items():
        assert one(spark, code, ind.valid_area_code("v")) is good


def test_paths(spark):
    expected = {
        "raw/dengue/x.zip": "SINAN/DATASUS", "raw/LIRAa_2020.zip": "LIRAa/SES-RJ", "raw/sinisa/a": "SINISA/Ministério das Cidades",
        "raw/snis/a": "SNIS/Ministério das Cidades", "raw/municipios.json": "IBGE", "x": "fonte_mista_ou_derivada",
    }
    for path, source in expected.items():
        assert one(spark, path, tx.source_of_path("v")) == source


def test_apportion(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 5.0), (-4.0, 1.0, 3.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(val.apportion(["a", "b", "c"], 500)).collect()]
    assert got == [[167, 167, 166], [0, 0, 500], [0, 125, 375], None]


def test_incidence(spark):
    df = spark.createDataFrame([(2, 100000), (2, 0)], "c long, p long")
    assert [r[0] for r in df.select(ind.incidence("c", "p")).collect()] == [0.02, None]


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(-0.0280, 88), (-0.0197, 66), (1.0, 5), (None, 9)], "r double, n long")
    got = [r[0] for r in df.select(ind.correlation_p("r", "n")).collect()]
    assert abs(got[0] - 0.7957) < 1e-3 and abs(got[1] - 0.8754) < 1e-3 and got[2] == 0.0 and got[3] is None
    chi = one(spark, 3.841458820694124, ind.chi2_upper_p("v", F.lit(1)), "double")
    assert abs(chi - 0.05) < 1e-9
    t = one(spark, 2.2281388519649385, ind.t_two_sided_p("v", F.lit(10)), "double")
    assert abs(t - 0.05) < 1e-9 and not math.isnan(t)
