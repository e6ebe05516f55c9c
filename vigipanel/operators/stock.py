"""Active stock from incident cases, hold-out metrics, stored runs and their peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigipanel import fixed_values as fv
from vigipanel.operators.joins import same_groups
from vigipanel.functions import as_col


def _in_order(keys, time):
    """Rows of one series; a series is one calendar long, whatever the data size."""
    return Window.partitionBy(*keys).orderBy(time)


def fixed_window_active(series: DataFrame, keys: list[str], time: str, cases: str, periods: int,
                        name: str = "active") -> DataFrame:
    """Cases of the last ``periods`` steps; the first rows are partial sums."""
    if periods < 1:
        raise ValueError(f"periods must be at least 1, got {periods}")
    frame = _in_order(keys, time).rowsBetween(-(periods - 1), 0)
    return series.withColumn(name, F.sum(as_col(cases).cast("double")).over(frame))


def outflow_fold(cases, gamma):
    """Array of stocks of ``I(t) = I(t-1) + C(t) - gamma * I(t-1)``."""
    start = F.array().cast("array<double>")
    rate = F.lit(float(gamma))

    def step(acc, current):
        previous = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0))
        return F.concat(acc, F.array(previous + current - rate * previous))

    return F.aggregate(cases, start, step)


def outflow_active(series: DataFrame, keys: list[str], time: str, cases: str, gamma: float,
                   name: str = "active_outflow") -> DataFrame:
    """Stock with proportional outflow, per series in time order."""
    if not 0 < gamma <= 1:
        raise ValueError(f"gamma must be in (0, 1], got {gamma}")
    packed = series.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(time), as_col(cases).cast("double").alias("_c")))).alias("_s")
    )
    stocks = outflow_fold(F.transform("_s", lambda e: e["_c"]), gamma)
    unpacked = packed.withColumn("_a", stocks).select(
        *keys, F.posexplode(F.arrays_zip("_s", "_a")).alias("_p", "_z")
    ).select(*keys, F.col(f"_z._s.{time}").alias(time), F.col("_z._a").alias(name))
    return same_groups(series, unpacked, [*keys, time])


def compare_estimators(series: DataFrame, keys: list[str], time: str, cases: str, periods: int,
                       detection: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Both estimators under each detection probability (a hypothesis, not an estimate)."""
    if any(not 0 < p <= 1 for p in detection):
        raise ValueError("detection probabilities must be in (0, 1]")
    options = F.array(*[F.lit(float(p)) for p in detection])
    corrected = (
        series.select(*keys, time, as_col(cases).cast("double").alias("reported"), F.explode(options).alias("detection"))
        .withColumn("corrected", F.col("reported") / F.col("detection"))
    )
    both = fixed_window_active(corrected, [*keys, "detection"], time, "corrected", periods, "active_window")
    return outflow_active(both, [*keys, "detection"], time, "corrected", 1 / periods, "active_outflow")


def holdout_metrics(fitted: DataFrame, keys: list[str], time: str, validation_size: int) -> DataFrame:
    """MAE and RMSE over all rows, the training part and the last ``validation_size`` rows.

    ``fitted`` holds ``observed`` and ``modelled``.
    """
    rows = (
        fitted.withColumn("_r", F.row_number().over(_in_order(keys, time)))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .withColumn("_res", F.col("modelled") - F.col("observed"))
        .withColumn("_train", F.col("_r") <= F.col("_n") - validation_size)
    )
    aggs = []
    for prefix, part in (("", F.lit(True)), ("train_", F.col("_train")), ("validation_", ~F.col("_train"))):
        aggs.append(F.avg(F.when(part, F.abs("_res"))).alias(f"{prefix}mae"))
        aggs.append(F.sqrt(F.avg(F.when(part, F.col("_res") * F.col("_res")))).alias(f"{prefix}rmse"))
    return rows.groupBy(*keys).agg(
        F.count_if("_train").alias("train_size"), F.count_if(~F.col("_train")).alias("validation_size"), *aggs
    )


def assess_calibration(results: DataFrame, scale, max_nrmse: float, tolerance: float,
                       lower: float, upper: float) -> DataFrame:
    """Reasons against a calibration, in a fixed order; accepted when there is none.

    ``results``: ``beta, converged, validation_size, validation_rmse``.
    """
    if not 0 <= tolerance < 0.5:
        raise ValueError("tolerance must be in [0, 0.5)")
    margin = (upper - lower) * tolerance
    nrmse = F.try_divide(F.col("validation_rmse"), as_col(scale))
    missing = (F.col("validation_size") == 0) | nrmse.isNull()
    at_bound = (F.col("beta") <= lower + margin) | (F.col("beta") >= upper - margin)
    reasons = F.filter(
        F.array(
            F.when(~F.col("converged"), fv.REASON_NOT_CONVERGED),
            F.when(missing, fv.REASON_NO_VALIDATION).when(nrmse > max_nrmse, fv.REASON_NRMSE),
            F.when(at_bound, fv.REASON_BOUND),
        ),
        lambda r: r.isNotNull(),
    )
    return (
        results.withColumn("validation_nrmse", nrmse).withColumn("at_bound", at_bound)
        .withColumn("reasons", F.array_join(reasons, "|"))
        .withColumn("accepted", F.col("reasons") == "")
    )


def cumulative_and_reproduction(runs: DataFrame) -> DataFrame:
    """Infections since the start of a run and the effective reproduction number.

    ``runs``: ``execution_id, code, day, susceptible, infected, removed,
    population, basic_reproduction``.
    """
    first = F.first("susceptible").over(_in_order(["execution_id", "code"], "day"))
    return runs.withColumn("cumulative_infections", first - F.col("susceptible")).withColumn(
        "effective_reproduction",
        F.try_divide(F.col("basic_reproduction") * F.col("susceptible"), F.col("population")),
    )


def scenario_comparison(base: DataFrame, alternative: DataFrame) -> DataFrame:
    """Base and intervention runs side by side on area and day."""
    left = cumulative_and_reproduction(base).select(
        "code", "day", F.col("susceptible").alias("susceptible_base"),
        F.col("infected").alias("infected_base"), F.col("removed").alias("removed_base"),
        F.col("cumulative_infections").alias("cumulative_base"),
        F.col("effective_reproduction").alias("effective_base"),
    )
    right = cumulative_and_reproduction(alternative).select(
        "code", "day", F.col("infected").alias("infected_intervention"),
        F.col("cumulative_infections").alias("cumulative_intervention"),
        F.col("effective_reproduction").alias("effective_intervention"),
    )
    return left.join(right, ["code", "day"])


def run_peaks(runs: DataFrame) -> DataFrame:
    """Highest stock of each run and the first day it is reached."""
    return runs.groupBy("execution_id", "code").agg(
        F.max("infected").alias("peak"),
        F.min_by("day", F.struct(-F.col("infected"), F.col("day"))).alias("peak_day"),
    )


def valid_parameters(table: DataFrame) -> DataFrame:
    """Scenario parameters inside their domain, with derived start and R0.

    ``population, infected, removed, beta, gamma``; the verdict stays as a
    column, so rejected rows can be reported.
    """
    names = ("population", "infected", "removed", "beta", "gamma")
    finite = None
    for name in names:
        value = F.col(name)
        test = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
        finite = test if finite is None else finite & test
    valid = (
        finite & (F.col("population") > 0) & (F.col("infected") >= 0) & (F.col("removed") >= 0)
        & (F.col("infected") + F.col("removed") <= F.col("population"))
        & (F.col("beta") >= 0) & (F.col("gamma") > 0)
    )
    return (
        table.withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("susceptible", F.when(F.col("valid"), F.col("population") - F.col("infected") - F.col("removed")))
        .withColumn("basic_reproduction", F.when(F.col("valid"), F.try_divide("beta", "gamma")))
    )
