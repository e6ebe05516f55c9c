"""Panel regressions with absorbed dummies and cluster-robust errors.

The published models are least squares of an outcome on a constant, one
standardised indicator and dummies.  The coefficient of interest, its
cluster-robust error, R2 and the Breusch-Pagan statistic depend on the dummies
only through what is left of a variable after they are swept out
(Frisch-Waugh-Lovell), so no design matrix is built: the dummies' normal
equations are solved by conjugate gradients.  Their matrix is the table of how
often two categories meet, their state a few numbers per category; rows are read
once before and once after.  All specifications are rows of one long table and
run in the same jobs; nothing but one number per turn reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigipanel import fixed_values as fv
from vigipanel.functions.indicators import chi2_upper_p, t_two_sided_p
from vigipanel.functions.values import standardised
from vigipanel.session import cut_lineage

SAMPLE = ["indicator", "lag"]
SPEC = ["indicator", "lag", "transform", "adjustment"]
_TOLERANCE = 1e-12        # of the residual, relative to the column
_ROUNDING, _PATIENCE = 1e-8, 100


def standardised_samples(panel: DataFrame, indicators: dict[str, str], lags: int = 3) -> DataFrame:
    """Long samples per indicator and lag with the indicator in deviations.

    Rows null in any used column go; outliers go only where the rule says so;
    the mean and the population deviation are those of the remaining rows.
    """
    from vigipanel.operators.association import lagged_pairs

    pairs = lagged_pairs(panel, {m: (rule,) for m, rule in indicators.items()}, lags)
    pairs = cut_lineage(pairs)
    moments = pairs.groupBy(*SAMPLE).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return pairs.join(moments, SAMPLE).select(
        *SAMPLE, "outlier_rule", "code", "year", "month", "reference_date",
        standardised("x", "_m", "_s").alias("x"), "y",
    )


def specifications(samples: DataFrame, transforms=fv.TRANSFORMS, adjustments=fv.ADJUSTMENTS) -> DataFrame:
    """Each sample row once per transform and adjustment, with its two categories."""
    options = []
    for transform in transforms:
        y = F.log1p("y") if transform == "log1p" else F.col("y")
        for adjustment in adjustments:
            first, second = {
                "bruto": (F.lit(""), F.lit("")),
                "tempo": (F.col("year").cast("string"), F.col("month").cast("string")),
                "municipio_rodada": (F.col("code"), F.col("reference_date").cast("string")),
            }[adjustment]
            options.append(F.struct(
                F.lit(transform).alias("transform"), F.lit(adjustment).alias("adjustment"),
                first.alias("c1"), second.alias("c2"), y.alias("y"),
            ))
    return samples.select(
        *SAMPLE, "outlier_rule", "code", "x", F.explode(F.array(*options)).alias("o")
    ).select(*SAMPLE, "outlier_rule", "code", "x", "o.*")


def _both_sides(rows: DataFrame, spec: list[str], **columns: Column) -> DataFrame:
    """Sums of ``columns`` by category, both categorisations in one table (``side``, ``level``)."""
    each = [F.struct(F.lit(side).alias("side"), F.col(c).alias("level"), *[v.alias(name) for name, v in columns.items()]) for side, c in ((1, "c1"), (2, "c2"))]
    return rows.select(*spec, F.inline(F.array(*each))).groupBy(*spec, "side", "level").agg(*[F.sum(name).alias(name) for name in columns])


def _of_side(state: DataFrame, spec: list[str], side: int, columns: dict[str, str]) -> DataFrame:
    return state.where(F.col("side") == side).select(*spec, F.col("level").alias(f"c{side}"), *[F.col(c).alias(name) for c, name in columns.items()])


def dummy_effects(df: DataFrame, spec: list[str], columns: list[str]) -> DataFrame:
    """Least-squares effects of both categories on each column: spec, side, level and one ``a_`` column each.

    Conjugate gradients on D'D a = D'y, preconditioned by the sizes of the
    categories.  D'D has the sizes on its diagonal and counts of (c1, c2) beside
    it, so a turn joins those counts with one number per category and adds up.  A
    balanced panel is done after two or three turns, a chain of categories after
    at most as many as there are.  It ends when the residual of every
    specification is down to ``_TOLERANCE`` of its column, or can fall no more.
    """
    cells = cut_lineage(df.groupBy(*spec, "c1", "c2").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"b_{c}") for c in columns], *[F.sum(F.col(c) * F.col(c)).alias(f"yy_{c}") for c in columns]))
    scale = cut_lineage(cells.groupBy(*spec).agg(*[F.sum(f"yy_{c}").alias(f"yy_{c}") for c in columns]))
    begin = _both_sides(cells, spec, n=F.col("n"), **{f"r_{c}": F.col(f"b_{c}") for c in columns})
    zero = F.lit(0.0)
    state = cut_lineage(begin.select("*", *[zero.alias(f"a_{c}") for c in columns], *[(F.col(f"r_{c}") / F.col("n")).alias(f"p_{c}") for c in columns]))
    key = [*spec, "side", "level"]
    least, still = float("inf"), 0
    while True:
        # the residual in the norm of the preconditioner, as a part of the column's own size
        rr = state.groupBy(*spec).agg(*[F.sum(F.col(f"r_{c}") * F.col(f"r_{c}") / F.col("n")).alias(f"rr_{c}") for c in columns])
        rr = rr.join(scale, spec).select(*spec, *[
            F.when(F.col(f"rr_{c}") > F.lit(_TOLERANCE ** 2) * F.col(f"yy_{c}"), F.col(f"rr_{c}")).otherwise(0.0).alias(f"rr_{c}") for c in columns
        ], F.greatest(zero, *[F.try_divide(F.col(f"rr_{c}"), F.col(f"yy_{c}")) for c in columns]).alias("part"))
        worst = rr.agg(F.max("part")).first()[0]
        if worst is None or worst <= _TOLERANCE ** 2:
            break
        still = 0 if worst < least else still + 1
        least = min(least, worst)
        if still >= _PATIENCE:
            if least <= _ROUNDING ** 2:
                break
            raise ValueError(f"dummies not swept out: the residual stays at {worst ** 0.5:.3g} of the column")
        met = cells
        for side in (1, 2):
            met = met.join(_of_side(state, spec, side, {f"p_{c}": f"p{side}_{c}" for c in columns}), [*spec, f"c{side}"])
        product = _both_sides(met, spec, **{f"q_{c}": F.col("n") * (F.col(f"p1_{c}") + F.col(f"p2_{c}")) for c in columns})
        state = cut_lineage(state.join(product, key))
        pq = state.groupBy(*spec).agg(*[F.sum(F.col(f"p_{c}") * F.col(f"q_{c}")).alias(f"pq_{c}") for c in columns])
        step = rr.join(pq, spec).select(*spec, *[F.coalesce(F.try_divide(F.col(f"rr_{c}"), F.col(f"pq_{c}")), zero).alias(f"step_{c}") for c in columns])
        moved = state.join(step, spec).select(
            *key, "n", *[f"p_{c}" for c in columns],
            *[(F.col(f"a_{c}") + F.col(f"step_{c}") * F.col(f"p_{c}")).alias(f"a_{c}") for c in columns],
            *[(F.col(f"r_{c}") - F.col(f"step_{c}") * F.col(f"q_{c}")).alias(f"r_{c}") for c in columns],
        )
        after = moved.groupBy(*spec).agg(*[F.sum(F.col(f"r_{c}") * F.col(f"r_{c}") / F.col("n")).alias(f"new_{c}") for c in columns])
        turn = after.join(rr, spec).select(*spec, *[F.coalesce(F.try_divide(F.col(f"new_{c}"), F.col(f"rr_{c}")), zero).alias(f"turn_{c}") for c in columns])
        state = cut_lineage(moved.join(turn, spec).select(
            *key, "n", *[f"a_{c}" for c in columns], *[f"r_{c}" for c in columns],
            *[(F.col(f"r_{c}") / F.col("n") + F.col(f"turn_{c}") * F.col(f"p_{c}")).alias(f"p_{c}") for c in columns],
        ))
    return state.select(*key, *[f"a_{c}" for c in columns])


def absorbed(df: DataFrame, spec: list[str], columns: list[str]) -> DataFrame:
    """Columns with both categories swept out."""
    effects = dummy_effects(df, spec, columns)
    for side in (1, 2):
        df = df.join(_of_side(effects, spec, side, {f"a_{c}": f"_a{side}_{c}" for c in columns}), [*spec, f"c{side}"])
    rest = {c: F.col(c) - F.col(f"_a1_{c}") - F.col(f"_a2_{c}") for c in columns}
    return cut_lineage(df.withColumns(rest).drop(*[f"_a{side}_{c}" for side in (1, 2) for c in columns]))


def clustered_models(rows: DataFrame, spec: list[str] = SPEC, cluster: str = "code") -> DataFrame:
    """One model per specification.

    ``rows``: spec columns, the cluster, ``x``, ``y``, categories ``c1, c2``
    ('' where there is none).  k counts the constant, the indicator and all
    dummies but one per category, as the published correction does, also where
    dummies are linearly dependent.
    """
    base = cut_lineage(rows)
    facts = base.groupBy(*spec).agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct(cluster).alias("clusters"),
        (F.count_distinct("c1") + F.count_distinct("c2")).alias("levels"),
        F.avg("y").alias("mean_y"),
    ).withColumn("k", F.col("levels").cast("long"))
    # levels - 2 dummies, plus the constant and the indicator
    swept = absorbed(base.withColumn("raw_y", F.col("y")), spec, ["x", "y"])
    slopes = swept.groupBy(*spec).agg(
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"),
    ).withColumn("coefficient", F.try_divide(F.col("xy"), F.col("xx")))
    residuals = (
        swept.join(slopes, spec).join(facts.select(*spec, "mean_y"), spec)
        .withColumn("e", F.col("y") - F.col("coefficient") * F.col("x"))
        .withColumn("e2", F.col("e") * F.col("e"))
    )
    scores = residuals.groupBy(*spec, cluster).agg(F.sum(F.col("x") * F.col("e")).alias("s"))
    meat = scores.groupBy(*spec).agg(F.sum(F.col("s") * F.col("s")).alias("meat"))
    fit = residuals.groupBy(*spec).agg(
        F.sum("e2").alias("rss"), F.sum(F.pow(F.col("raw_y") - F.col("mean_y"), 2)).alias("tss"),
        F.avg("e2").alias("mean_e2"),
    )
    # Breusch-Pagan: squared residuals on the same design
    auxiliary = absorbed(
        residuals.select(*spec, "c1", "c2", "x", "e2", F.col("e2").alias("raw_e2")), spec, ["e2"]
    )
    aux_slope = auxiliary.groupBy(*spec).agg(
        F.try_divide(F.sum(F.col("x") * F.col("e2")), F.sum(F.col("x") * F.col("x"))).alias("b2")
    )
    aux_fit = (
        auxiliary.join(aux_slope, spec).join(fit.select(*spec, "mean_e2"), spec)
        .groupBy(*spec).agg(
            F.sum(F.pow(F.col("e2") - F.col("b2") * F.col("x"), 2)).alias("aux_rss"),
            F.sum(F.pow(F.col("raw_e2") - F.col("mean_e2"), 2)).alias("aux_tss"),
        )
    )
    g, n, k = F.col("clusters"), F.col("observations"), F.col("k")
    correction = F.try_divide(g, g - 1) * F.try_divide(n - 1, n - k)
    error = F.sqrt(F.greatest(correction * F.col("meat") / (F.col("xx") * F.col("xx")), F.lit(0.0)))
    aux_r2 = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("aux_rss"), F.col("aux_tss")))
    return (
        facts.join(slopes, spec).join(meat, spec).join(fit, spec).join(aux_fit, spec)
        .withColumn("cluster_error", error)
        .withColumn("t_statistic", F.try_divide("coefficient", "cluster_error"))
        .withColumn("p_value", t_two_sided_p("t_statistic", g - 1))
        .withColumn("r_squared", 1 - F.try_divide(F.col("rss"), F.col("tss")))
        .withColumn("bp_statistic", n * F.coalesce(aux_r2, F.lit(0.0)))
        .withColumn("bp_p", chi2_upper_p("bp_statistic", F.greatest(F.lit(1), k - 1)))
        .select(*spec, "observations", "clusters", "coefficient", "cluster_error", "t_statistic",
                "p_value", "r_squared", "bp_statistic", "bp_p")
    )


def model_grid(panel: DataFrame, indicators: dict[str, str], lags: int = 3) -> DataFrame:
    """All published specifications: indicators x lags x transforms x adjustments."""
    samples = standardised_samples(panel, indicators, lags)
    rule = None
    for measure, name in indicators.items():
        test = F.col("indicator") == measure
        rule = F.when(test, name) if rule is None else rule.when(test, name)
    return (
        clustered_models(specifications(samples).drop("outlier_rule"))
        .withColumn("outlier_rule", rule)
        .withColumn("note", F.lit(fv.COEFFICIENT_NOTE))
    )
