"""Correlations, their leave-one-out influence, and descriptive line fits.

Input is long: group columns, ``x``, ``y`` and, for influence, a unique ``id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigipanel import fixed_values as fv
from vigipanel.operators.joins import same_groups
from vigipanel.functions.indicators import correlation_p
from vigipanel.functions.values import largest_absolute
from vigipanel.operators.ranking import average_ranks, running_totals
from vigipanel.session import cut_lineage


def _axis_ranks(valid: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Average ranks of x and of y, found in one ordered pass over both."""
    both = valid.select(*groups, F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")),
        F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")),
    )).alias("e")).select(*groups, "e.*")
    ranks = average_ranks(both, [*groups, "axis"], "v")

    def of(axis: str, name: str) -> DataFrame:
        return ranks.where(F.col("axis") == axis).select(
            *groups, F.col("v").alias(axis), F.col("rank").alias(name)
        )

    return of("x", "rx"), of("y", "ry")


def correlations(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """Pearson and Spearman with two-sided p, pairs with a null left out."""
    valid = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*groups, "x", "y")
    valid = cut_lineage(valid)
    plain = valid.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("observations"), F.corr("x", "y").alias("pearson_r")
    )
    cells = valid.groupBy(*groups, "x", "y").agg(F.count(F.lit(1)).alias("_c"))
    rx, ry = _axis_ranks(valid, groups)
    sizes = plain.select(*groups, ((F.col("observations") + 1) / 2).alias("_mid"))
    c = F.col("_c")
    dx, dy = F.col("rx") - F.col("_mid"), F.col("ry") - F.col("_mid")
    ranked = (
        same_groups(same_groups(same_groups(cells, rx, [*groups, "x"]), ry, [*groups, "y"]), sizes, groups)
        .groupBy(*groups)
        .agg(F.sum(c * dx * dy).alias("_xy"), F.sum(c * dx * dx).alias("_xx"), F.sum(c * dy * dy).alias("_yy"))
        .select(*groups, F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias("spearman_rho"))
    )
    return (
        same_groups(plain, ranked, groups, "left")
        .withColumn("pearson_p", correlation_p("pearson_r", "observations"))
        .withColumn("spearman_p", correlation_p("spearman_rho", "observations"))
    )


def lagged_pairs(panel: DataFrame, indicators: dict[str, tuple[str, ...]], lags: int = 3) -> DataFrame:
    """One long table of all (indicator, lag, outlier rule) samples.

    ``indicators`` maps a measure to its outlier rules.  A row null in the
    measure, the outcome or the flag is in no sample.
    """
    samples = []
    for measure, rules in indicators.items():
        for lag in range(lags + 1):
            for rule in rules:
                keep = F.col(measure).isNotNull() & F.col(f"incidence_{lag}").isNotNull() & F.col("outlier").isNotNull()
                if rule == fv.OUTLIER_EXCLUDED:
                    keep = keep & ~F.col("outlier")
                samples.append(
                    F.when(keep, F.struct(
                        F.lit(measure).alias("indicator"), F.lit(lag).alias("lag"),
                        F.lit(rule).alias("outlier_rule"),
                        F.col(measure).cast("double").alias("x"),
                        F.col(f"incidence_{lag}").alias("y"),
                    ))
                )
    keys = [c for c in ("code", "year", "month", "reference_date") if c in panel.columns]
    return (
        panel.select(*keys, F.explode(F.filter(F.array(*samples), lambda s: s.isNotNull())).alias("s"))
        .select(*keys, "s.*")
    )


def lag_associations(panel: DataFrame, indicators: dict[str, tuple[str, ...]], lags: int = 3) -> DataFrame:
    pairs = lagged_pairs(panel, indicators, lags)
    return correlations(pairs, ["indicator", "lag", "outlier_rule"]).withColumn(
        "note", F.lit(fv.LAGGED_NOTE)
    )


# --- leave one out -----------------------------------------------------------


def _both_above(cells: DataFrame, groups: list[str]) -> DataFrame:
    """Per cell (x, y): how many rows of the group lie above it in x and in y.

    ``cells``: groups, ``x``, ``y``, ``c`` (rows of the cell), ``px`` (0-based
    position of x among the distinct values) and ``nx`` (how many there are).
    Every row is put into one block of positions per binary level; a cell asks,
    on each level where its own digit is 0, the sibling block to its right.
    Rows grow with the number of levels, never with pairs, and inside a block
    only an ordered total over y is needed.
    """
    top = F.ceil(F.log2(F.greatest(F.col("nx"), F.lit(2)))).cast("int")
    leveled = cells.select("*", F.explode(F.sequence(F.lit(0), top)).alias("level"))
    block = F.expr("shiftright(px, level)")
    points = leveled.select(
        *groups, "level", block.alias("block"), (-F.col("y")).alias("down"),
        F.lit(1).alias("kind"), F.col("c").alias("w"),
    )
    asks = (
        leveled.where((F.expr("shiftright(px, level) & 1") == 0)
                      & (block + 1 <= F.expr("shiftright(nx - 1, level)")))
        .select(*groups, "x", "y", "level", (block + 1).alias("block"), (-F.col("y")).alias("down"))
    )
    events = points.unionByName(
        asks.select(*groups, "level", "block", "down", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("w"))
    ).groupBy(*groups, "level", "block", "down", "kind").agg(F.sum("w").alias("w"))
    keys = [*groups, "level", "block"]
    answers = running_totals(events, keys, ["down", "kind"], {"above": "w"}).where(F.col("kind") == 0)
    return cut_lineage(
        same_groups(asks, answers.select(*keys, "down", "above"), [*keys, "down"])
        .groupBy(*groups, "x", "y").agg(F.sum("above").alias("both_above"))
    )


def _axis_rows(cells: DataFrame, groups: list[str]) -> DataFrame:
    """Cells once per axis: own value, the other value, own and other centred rank."""
    def view(axis, v, w, own, other):
        return F.struct(
            F.lit(axis).alias("axis"), F.col(v).alias("v"), F.col(w).alias("w"),
            F.col(own).alias("own"), F.col(other).alias("other"),
        )

    return cells.select(*groups, "c", F.explode(F.array(
        view("x", "x", "y", "u", "v"), view("y", "y", "x", "v", "u"),
    )).alias("e")).select(*groups, "c", "e.*")


def _sides(cells: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ordered totals along each axis: rows and centred ranks below each value."""
    per_value = _axis_rows(cells, groups).groupBy(*groups, "axis", "v").agg(
        F.sum("c").alias("same"), F.sum(F.col("c") * F.col("own")).alias("own"),
        F.sum(F.col("c") * F.col("other")).alias("other"), F.lit(1).cast("long").alias("one"),
    )
    below = running_totals(
        per_value, [*groups, "axis"], ["v"],
        {"rows_below": "same", "own_below": "own", "other_below": "other", "pos": "one"},
    )

    def of(axis: str) -> DataFrame:
        return below.where(F.col("axis") == axis).select(
            *groups, F.col("v").alias(axis), F.col("same").alias(f"{axis}_same"),
            F.col("rows_below").alias(f"{axis}_below"),
            (-2 * F.col("own_below") - F.col("own")).alias(f"{axis}_own_sign"),
            (-2 * F.col("other_below") - F.col("other")).alias(f"{axis}_other_sign"),
            F.col("pos").alias(f"p{axis}"),
        )

    return of("x"), of("y")


def _ties(cells: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows tied in x with a lower y, and rows tied in y with a lower x."""
    below = running_totals(
        _axis_rows(cells, groups).select(*groups, "axis", "v", "w", "c"),
        [*groups, "axis", "v"], ["w"], {"low": "c"},
    )
    tied_x = below.where(F.col("axis") == "x").select(
        *groups, F.col("v").alias("x"), F.col("w").alias("y"), F.col("low").alias("tied_x_below"))
    tied_y = below.where(F.col("axis") == "y").select(
        *groups, F.col("w").alias("x"), F.col("v").alias("y"), F.col("low").alias("tied_y_below"))
    return tied_x, tied_y


def leave_one_out(pairs: DataFrame, groups: list[str], labels: list[str]) -> DataFrame:
    """Both correlations without each row in turn, and how far they move.

    Removing a row lowers every higher rank by one and every tied rank by one
    half, so the reduced Spearman coefficient follows from ordered totals and
    from counts of rows above in both directions; no reduced sample is built.
    """
    valid = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*groups, *labels, "x", "y")
    valid = cut_lineage(valid)
    moments = valid.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
    )
    cells = valid.groupBy(*groups, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    rx, ry = _axis_ranks(valid, groups)
    mid = (F.col("n") + 1) / 2
    centred = (
        same_groups(same_groups(same_groups(cells, rx, [*groups, "x"]), ry, [*groups, "y"]), moments, groups)
        .withColumn("u", F.col("rx") - mid).withColumn("v", F.col("ry") - mid)
        .withColumn("dx", F.col("x") - F.col("mx")).withColumn("dy", F.col("y") - F.col("my"))
        .drop("rx", "ry")
    )
    centred = cut_lineage(centred)
    c = F.col("c")
    totals = centred.groupBy(*groups).agg(
        F.sum(c * F.col("dx") * F.col("dx")).alias("sxx"), F.sum(c * F.col("dy") * F.col("dy")).alias("syy"),
        F.sum(c * F.col("dx") * F.col("dy")).alias("sxy"),
        F.sum(c * F.col("u") * F.col("u")).alias("suu"), F.sum(c * F.col("v") * F.col("v")).alias("svv"),
        F.sum(c * F.col("u") * F.col("v")).alias("suv"),
        F.count_distinct("x").alias("nx"),
    )
    sx, sy = _sides(centred, groups)
    placed = cut_lineage(same_groups(same_groups(same_groups(centred, sx, [*groups, "x"]), sy, [*groups, "y"]), totals, groups))
    both = _both_above(
        placed.select(*groups, "x", "y", "c", F.col("px").cast("long").alias("px"), F.col("nx").cast("long").alias("nx")),
        groups,
    )
    tied_x, tied_y = _ties(centred, groups)
    full = same_groups(placed, both, [*groups, "x", "y"], "left")
    full = same_groups(same_groups(full, tied_x, [*groups, "x", "y"]), tied_y, [*groups, "x", "y"])
    n = F.col("n")
    gg = F.coalesce(F.col("both_above"), F.lit(0))
    x_above = n - F.col("x_below") - F.col("x_same")
    y_above = n - F.col("y_below") - F.col("y_same")
    eg = F.col("x_same") - F.col("tied_x_below") - c      # x tied, y above
    ge = F.col("y_same") - F.col("tied_y_below") - c      # x above, y tied
    gl = x_above - gg - ge
    lg = y_above - gg - eg
    le = F.col("tied_y_below")
    ll = F.col("x_below") - lg - le
    concord = gg + ll - gl - lg
    u, v = F.col("u"), F.col("v")
    num = F.col("suv") - u * v - F.col("y_other_sign") / 2 - F.col("x_other_sign") / 2 + concord / 4
    den_x = F.col("suu") - u * u - F.col("x_own_sign") + (n - F.col("x_same")) / 4
    den_y = F.col("svv") - v * v - F.col("y_own_sign") + (n - F.col("y_same")) / 4
    less = n - 1
    dx, dy = F.col("dx"), F.col("dy")
    cov = F.col("sxy") - dx * dy - dx * dy / less
    var_x = F.col("sxx") - dx * dx - dx * dx / less
    var_y = F.col("syy") - dy * dy - dy * dy / less
    per_cell = full.select(
        *groups, "x", "y",
        F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("pearson_base"),
        F.try_divide(cov, F.sqrt(var_x * var_y)).alias("pearson_without"),
        F.try_divide(F.col("suv"), F.sqrt(F.col("suu") * F.col("svv"))).alias("spearman_base"),
        F.try_divide(num, F.sqrt(den_x * den_y)).alias("spearman_without"),
    )
    return (
        same_groups(valid, per_cell, [*groups, "x", "y"])
        .withColumn("delta_pearson", F.col("pearson_without") - F.col("pearson_base"))
        .withColumn("delta_spearman", F.col("spearman_without") - F.col("spearman_base"))
        .withColumn("largest_influence", largest_absolute("delta_pearson", "delta_spearman"))
        .drop("x", "y")
    )


def linear_fits(pairs: DataFrame, groups: list[str]) -> DataFrame:
    return pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*groups).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
    )


def largest_residuals(pairs: DataFrame, groups: list[str], k: int = 5) -> DataFrame:
    """The k rows farthest from the descriptive line of their group, ties by id."""
    valid = cut_lineage(pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    fitted = same_groups(valid, linear_fits(valid, groups), groups).withColumn(
        "residual", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))
    )
    window = Window.partitionBy(*groups).orderBy(F.abs("residual").desc(), F.col("id"))
    return fitted.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)
