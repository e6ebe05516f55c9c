"""Surveillance views over the given tables (the inputs of the registered queries).

Nations are areas, customers are inhabitants, order lines are notification
records, suppliers are service providers.  Nothing is made up: every row of a
view comes from rows of the tables.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions import indicators as ind, records as rec, values as val
from vigipanel.operators import neighbours, reconcile, series

FIRST_YEAR, LAST_YEAR = 1995, 2000
SURVEY_LIMIT = 26.0
NOT_COMPUTED = "Não Calc.- Div/0"
LETTER = "Ofício com justificativa"

# legacy code, current code, numerator column, times 100
MEASURES = (
    ("IN055", "IAG0001", "n_a", 100), ("IN049", "IAG2013", "tax", 1), ("IN015", "IES2002", "qty", 1),
    ("IN046", "IES2003", "disc", 1), ("IN056", "IES0001", "n_f", 100),
)
CURRENT_FROM = 2000      # from this year on providers report the current codes
TASK_ROWS = 500_000      # order lines that a task joins at most, about


def whole(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: whole numbers as long, fractions to ``digits`` places."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("integer", "short", "byte"):
            column = column.cast("long")
        elif kind in ("double", "float"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` in as many parts by ``key`` as ``rows`` need, where they are more than the session's own."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def area(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.concat(F.lit("33"), F.lpad(key.cast("string"), 4, "0"), (key % 10).cast("string")).alias("code"),
            F.col("n_name").alias("name"), F.col("r_regionkey").cast("string").alias("region_code"),
            F.col("r_name").alias("region"), (key % 5).cast("double").alias("x"),
            F.floor(key / 5).cast("double").alias("y"), key.alias("key"),
        )

    @cached_property
    def population(self) -> DataFrame:
        people = self.table("customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        years = F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))
        return people.join(self.area.select("code", "key"), "key").select(
            "code", "n", F.explode(years).alias("year")
        ).select("code", "year", (F.col("n") * 1000 + (F.col("year") - FIRST_YEAR) * 10).alias("population"))

    @cached_property
    def staged(self) -> DataFrame:
        """Records as reported: six-digit residence, class text, two dates."""
        lines = self.table("lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        people = self.table("customer").select("c_custkey", "c_nationkey")
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        severe = F.when(F.col("l_quantity") > 45, "12").otherwise("11")
        class_code = (
            F.when(flag == "R", "5").when((flag == "A") & (status == "F"), "10")
            .when(flag == "A", severe).when(status == "F", "8")
        )
        rows = lines.count()
        placed = spread(orders.join(people, F.col("o_custkey") == F.col("c_custkey")), rows, "o_orderkey")
        return (
            spread(lines, rows, "l_orderkey").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat(F.lit("33"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0")).alias("residence_code"),
                F.year("l_shipdate").alias("base_year"),
                F.col("o_orderdate").cast("date").alias("symptom_date"),
                F.col("l_shipdate").cast("date").alias("notification_date"),
                rec.iso_week_text(F.col("o_orderdate").cast("date")).alias("symptom_week"),
                class_code.alias("class_code"),
            )
        )

    @cached_property
    def records(self) -> DataFrame:
        return series.typed_records(reconcile.reconcile_codes(self.staged, "residence_code", self.area))

    @cached_property
    def sparse_records(self) -> DataFrame:
        """Severe records with a delay of 1 to 59 days: most annual cells are empty."""
        return self.records.where((F.col("class_code") == "12") & F.col("delay_days").between(1, 59))

    @cached_property
    def annual(self) -> DataFrame:
        return series.annual_incidence(self.records, self.area, self.population, FIRST_YEAR, LAST_YEAR)

    @cached_property
    def annual_sparse(self) -> DataFrame:
        return series.annual_incidence(self.sparse_records, self.area, self.population, FIRST_YEAR, LAST_YEAR)

    @cached_property
    def monthly(self) -> DataFrame:
        return series.monthly_series(self.records, self.area, FIRST_YEAR, LAST_YEAR)

    @cached_property
    def weekly(self) -> DataFrame:
        return series.weekly_series(self.records, self.area, FIRST_YEAR, LAST_YEAR)

    @cached_property
    def provider_year(self) -> DataFrame:
        """Whole-number sums per provider and year; ratios are formed without rounding drift."""
        lines = self.table("lineitem").select(
            "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
        )
        sums = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
            F.sum(F.col("l_quantity").cast("long")).alias("qty"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
            F.count_if(F.col("l_linestatus") == "F").alias("n_f"),
        )
        providers = self.table("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("key"))
        return sums.join(providers, F.col("l_suppkey") == F.col("s_suppkey")).join(
            self.area.select("code", "key"), "key"
        ).drop("key", "l_suppkey")

    @cached_property
    def indicators_wide(self) -> DataFrame:
        """One text column per legacy code; decimal comma, a reason, or nothing."""
        n = F.col("n")
        columns = []
        for legacy, _, numerator, times in MEASURES:
            units = F.expr(f"({numerator} * {times} * 10000 * 2 + n) div (2 * n)")
            text = F.concat(
                F.expr(f"({numerator} * {times} * 10000 * 2 + n) div (2 * n) div 10000").cast("string"), F.lit(","),
                F.lpad((units % 10000).cast("string"), 4, "0"),
            )
            columns.append(F.when(n % 11 == 0, NOT_COMPUTED).when(n % 13 == 0, "").otherwise(text).alias(legacy))
        return self.provider_year.select(
            "code", "year", F.col("s_suppkey").alias("provider_code"), F.col("s_name").alias("provider_name"), *columns
        )

    @cached_property
    def indicators(self) -> DataFrame:
        """The long fact: typed values, statuses, component, system, standard code."""
        keys = ["code", "year", "provider_code", "provider_name"]
        long = self.indicators_wide.unpivot(keys, [m[0] for m in MEASURES], "legacy", "raw_value")
        current = F.lit(None).cast("string")
        for legacy, code, _, _ in MEASURES:
            current = F.when(F.col("legacy") == legacy, code).otherwise(current)
        new = F.col("year") >= CURRENT_FROM
        named = long.withColumn("indicator", F.when(new, current).otherwise(F.col("legacy"))).select(
            *keys, "indicator",
            F.when(new, fv.CURRENT_SYSTEM).otherwise(fv.LEGACY_SYSTEM).alias("system"),
            ind.fact_component("legacy").alias("component"),
            F.concat(F.lit("Indicador "), F.col("indicator"),
                     F.when(F.col("year").between(1998, 1999), " (revisado)").otherwise("")).alias("name"),
            F.lit("percentual").alias("unit"),
            F.when(new, F.lit("Atendimento")).alias("family"), F.lit("").alias("formula"),
            "raw_value", val.decimal_comma("raw_value").alias("value"),
            F.lit("municipio_prestador").alias("source_level"),
        ).withColumn("value_status", val.value_status("raw_value", "value"))
        return reconcile.harmonised(named, reconcile.comparability(self.spark))

    @cached_property
    def area_indicators(self) -> DataFrame:
        """One value per area, year and code: that of the first provider by number."""
        return self.indicators.groupBy("code", "year", "indicator").agg(
            F.min_by("value", "provider_code").alias("value")
        )

    @cached_property
    def survey(self) -> DataFrame:
        lines = self.table("lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_shipdate")
        day = F.col("l_shipdate").cast("date")
        # a date bound, so that the scan can prune by it
        rounds = lines.where((day < F.lit(date(LAST_YEAR + 1, 1, 1))) & F.month(day).isin(1, 4, 7, 10))
        # lines are counted per provider before providers meet their area
        sums = rounds.groupBy("l_suppkey", F.year(day).alias("year"), F.month(day).alias("month")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
            F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        )
        places = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("key")).join(
            self.area.select("code", "key"), "key"
        )
        cells = sums.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("code", "year", "month").agg(
            F.sum("n").alias("n"), F.sum("disc").alias("disc"), F.sum("qty").alias("qty")
        )
        n = F.col("n")
        return cells.select(
            "code", "year", "month", F.make_date("year", "month", F.lit(1)).alias("reference_date"),
            F.when(n % 9 != 0, F.round(F.col("disc").cast("double") / n, 6)).alias("iip"),
            F.round(F.col("qty").cast("double") / n, 6).alias("ib"),
            F.when(n % 2 == 0, LETTER).otherwise("").alias("period_text"),
        ).select(
            "code", "year", "month", "reference_date", "iip", "ib",
            val.survey_status("iip", "period_text").alias("status"), val.above("ib", SURVEY_LIMIT).alias("outlier"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        return series.survey_panel(self.survey, self.area, self.population, self.monthly)

    @cached_property
    def rings(self) -> DataFrame:
        """Each area as the unit square of its grid position."""
        return self._squares(self.area)

    @staticmethod
    def _squares(places: DataFrame) -> DataFrame:
        """Rings of unit squares, four corners in order."""
        corner = [(0, 0), (1, 0), (1, 1), (0, 1)]
        corners = F.array(*[
            F.struct(F.lit(i).alias("seq"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
            for i, (dx, dy) in enumerate(corner)
        ])
        return places.select("code", F.explode(corners).alias("c")).select("code", F.lit(0).alias("ring"), "c.*")

    @cached_property
    def customer_mesh(self) -> DataFrame:
        """Customers as unit squares, a hundred to a row of the map."""
        place = self.table("customer").select(
            F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"),
            (F.col("c_custkey") % 100).cast("double").alias("x"), F.floor(F.col("c_custkey") / 100).cast("double").alias("y"),
        )
        return self._squares(place)

    @cached_property
    def queen(self) -> DataFrame:
        return neighbours.contiguity(self.rings)

    @cached_property
    def rook(self) -> DataFrame:
        return neighbours.edge_contacts_only(self.queen)

    @cached_property
    def knn4(self) -> DataFrame:
        centres = neighbours.centroids(self.rings).select("code", F.col("cx").alias("x"), F.col("cy").alias("y"))
        return neighbours.nearest(centres, 4)

    @cached_property
    def incidence_values(self) -> DataFrame:
        return self.annual.select("year", "code", F.col("incidence").alias("value"))

    def runs(self, which: str) -> DataFrame:
        """A stored run per area: base from probable, intervention from discarded cases."""
        cases = {"base": "probable_cases", "intervention": "discarded_cases"}[which]
        from pyspark.sql import Window

        order = Window.partitionBy("code").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
        people = self.population.where(F.col("year") == FIRST_YEAR).select("code", "population")
        return (
            self.monthly.withColumn("_sum", F.sum(cases).over(order))
            .join(people, "code").join(self.area.select("code", "key"), "code")
            .select(
                F.lit(which).alias("execution_id"), "code", "name",
                F.months_between("month", F.lit(f"{FIRST_YEAR}-01-01").cast("date")).cast("long").alias("day"),
                (F.col("population") - F.col("_sum")).cast("double").alias("susceptible"),
                F.col(cases).cast("double").alias("infected"),
                (F.col("_sum") - F.col(cases)).cast("double").alias("removed"),
                F.col("population").cast("double").alias("population"),
                (F.lit(1.0) + (F.col("key") % 5) / 10).alias("basic_reproduction"),
            )
        )
