"""Records to indicators, dense grids and panels on small hand-made inputs."""

import datetime as dt

from vigipanel import fixed_values as fv
from vigipanel.operators import quality as dq, reconcile, series, summary

D = dt.date


def _records(spark):
    staged = spark.createDataFrame(
        [
            ("3300100", "330010", "2020", "2020-01-05", "20200107", "202002", "5"),
            ("3300100", "330010", "2020", "2020-01-06", "2020-01-06", "202002", "10"),
            ("3300100", "330010", "2020", "2020-03-01", "2020-03-02", "202010", None),
            ("3300159", "330015", "2020", "2019-12-30", "2020-01-02", "202001", "8"),
            ("3300159", "330015", "2020", "junk", None, "999999", "0"),
        ],
        "code string, residence_code string, base_year string, symptom_date string, notification_date string, symptom_week string, class_code string",
    )
    return series.typed_records(staged, first_text_dates=True)


def test_annual_has_zero_rows(spark, areas):
    population = spark.createDataFrame([(c, y, 100000) for c in ("3300100", "3300159", "3304904") for y in (2020, 2021)], "code string, year int, population long")
    rows = {(r["code"], r["year"]): r for r in series.annual_incidence(_records(spark), areas, population, 2020, 2021).collect()}
    assert len(rows) == 6
    first = rows["3300100", 2020]
    assert (first["probable_cases"], first["discarded_cases"], first["classified_cases"], first["unlabelled_cases"]) == (2, 1, 1, 1)
    assert first["incidence"] == 0.02 and rows["3304904", 2021]["incidence"] == 0.0
    assert first["area_criterion"] == fv.AGGREGATE_CRITERION


def test_dense_series(spark, areas):
    monthly = series.monthly_series(_records(spark), areas, 2020, 2020).collect()
    assert len(monthly) == 3 * 12 and sum(r["probable_cases"] for r in monthly) == 2
    weekly = series.weekly_series(_records(spark), areas, 2020, 2024).collect()
    assert {r["week"] for r in weekly} == {"202001", "202002", "202010"} and len(weekly) == 9
    # two calendars: the record of December counts by week, not by month
    assert sum(r["probable_cases"] for r in weekly) == 3


def test_coverage(spark):
    row = series.record_coverage(_records(spark), 2020, 2020).first()
    assert (row["records"], row["valid_symptom_dates"], row["symptoms_outside_period"], row["median_delay_days"]) == (5, 4, 1, 1.5)


def test_lags_off_grid_are_null(spark, areas):
    monthly = series.monthly_series(_records(spark), areas, 2020, 2020)
    survey = spark.createDataFrame(
        [("3300100", 2020, 1, D(2020, 1, 1), 1.0), ("3300100", 2020, 11, D(2020, 11, 1), 1.0), ("3300100", 2020, 12, D(2019, 12, 1), 1.0)],
        "code string, year int, month int, reference_date date, iip double",
    )
    population = spark.createDataFrame([("3300100", 2020, 1000)], "code string, year int, population long")
    rows = {r["reference_date"]: r for r in series.survey_panel(survey, areas, population, monthly).collect()}
    assert [rows[D(2020, 1, 1)][f"cases_{k}"] for k in range(4)] == [1, 0, 1, 0]
    assert [rows[D(2020, 11, 1)][f"cases_{k}"] for k in range(4)] == [0, 0, None, None]
    assert [rows[D(2019, 12, 1)][f"cases_{k}"] for k in range(4)] == [None, 1, 0, 1]
    assert rows[D(2020, 1, 1)]["incidence_0"] == 1.0


def test_extremes_break_ties_by_code(spark):
    annual = spark.createDataFrame([("b", "B", 2020, 1.0), ("a", "A", 2020, 1.0), ("c", "C", 2020, 0.5)], "code string, name string, year int, incidence double")
    rows = summary.annual_extremes(annual, 2).collect()
    high = [r["code"] for r in sorted(rows, key=lambda r: r["position"]) if r["extreme"] == "maior"]
    low = [r["code"] for r in sorted(rows, key=lambda r: r["position"]) if r["extreme"] == "menor"]
    assert high == ["a", "b"] and low == ["c", "a"]


def test_thinning(spark):
    df = spark.range(130).selectExpr("'s' AS k", "id AS t")
    assert sorted(r["t"] for r in summary.thinned(df, ["k"], "t", 60).collect()) == list(range(0, 130, 3))


def test_lookup_is_injection_safe(spark, areas):
    assert summary.lookup(areas, "x' OR '1'='1", ["code"], ["code"]).count() == 0
    assert summary.lookup(areas, "3300100", ["name"], ["name"]).first()["name"] == "Angra dos Reis"


def test_regions(spark):
    regions = spark.createDataFrame([("São Gonçalo", "33006", "Metropolitana II"), ("Aperibé", "33007", "Noroeste")], "area_name string, region_code string, region string")
    assert dq.unique_key(regions, ["area_name"]).isEmpty()
    named = spark.createDataFrame([(3304904, "São  Gonçalo"), (3300159, "APERIBE")], "code long, name string")
    got = {r["code"]: r["region"] for r in reconcile.area_dimension(named, regions).collect()}
    assert got == {"3304904": "Metropolitana II", "3300159": "Noroeste"}


def test_code_rules(spark, areas):
    df = spark.createDataFrame([("330010",), (" 330015 ",), ("990000",)], "r string")
    assert sorted(r["code"] for r in reconcile.reconcile_codes(df, "r", areas).collect()) == ["3300100", "3300159"]
    passed = reconcile.passthrough_codes(spark.createDataFrame([("3300100.0",), ("330015",), ("1",)], "r string"), "r", areas)
    assert {r["source_code"]: r["code"] for r in passed.collect()} == {"3300100": "3300100", "330015": "3300159", "1": None}


def test_standard_codes(spark):
    rows = spark.createDataFrame([("IN055",), ("IN015",), ("IES0001",), ("IN999",)], "indicator string")
    got = {r["indicator"]: (r["standard_code"], r["comparability"]) for r in reconcile.harmonised(rows, reconcile.comparability(spark)).collect()}
    assert got["IN055"] == ("IAG0001", "comparavel_direto") and got["IN015"] == (None, "similar_com_ruptura_definicao")
    assert got["IES0001"][0] == "IES0001" and got["IN999"] == (None, "nao_avaliado")
