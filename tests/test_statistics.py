"""Statistics against numpy or brute force on small inputs with ties and gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigipanel import fixed_values as fv
from vigipanel.operators import association as assoc, bijection, neighbours, quality as dq, ranking, regression as reg, spatial, stock


def _ranks(v):
    return pd.Series(v).rank().to_numpy()


def test_running_totals_with_few_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(k), int(rng.integers(1, 9))) for g in ("a", "b") for k in rng.permutation(300)]
    df = spark.createDataFrame(rows, "g string, k long, w long")
    got = {(r["g"], r["k"]): r["t"] for r in ranking.running_totals(df, ["g"], ["k"], {"t": "w"}, splits=7).collect()}
    for g in ("a", "b"):
        total = 0
        for _, k, w in sorted(r for r in rows if r[0] == g):
            assert got[g, k] == total
            total += w


def test_quantiles(spark):
    values = [0.0, 0.0, 0.0, 1.5, 2.0, 9.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = ranking.exact_quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).first()
    assert np.allclose(list(row), np.quantile([v for v in values if v is not None], [0.25, 0.5, 0.99]))


def test_correlations_and_leave_one_out(spark):
    rng = np.random.default_rng(5)
    frames = {g: (rng.integers(0, 6, n).astype(float), rng.integers(0, 5, n).astype(float)) for g, n in (("a", 40), ("b", 17))}
    rows = [(g, i, float(x), float(y)) for g, (xs, ys) in frames.items() for i, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    whole = {r["g"]: r for r in assoc.correlations(df, ["g"]).collect()}
    left = {(r["g"], r["id"]): r for r in assoc.leave_one_out(df, ["g"], ["id"]).collect()}
    for g, (x, y) in frames.items():
        p, s = np.corrcoef(x, y)[0, 1], np.corrcoef(_ranks(x), _ranks(y))[0, 1]
        assert np.isclose(whole[g]["pearson_r"], p) and np.isclose(whole[g]["spearman_rho"], s)
        for i in range(len(x)):
            xi, yi = np.delete(x, i), np.delete(y, i)
            assert np.isclose(left[g, i]["pearson_without"], np.corrcoef(xi, yi)[0, 1])
            assert np.isclose(left[g, i]["spearman_without"], np.corrcoef(_ranks(xi), _ranks(yi))[0, 1])
            assert np.isclose(left[g, i]["spearman_base"], s)


def _dense_model(y, x, d1, d2, clusters):
    """Least squares with all dummies, for comparison only."""
    columns = [np.ones_like(x), x]
    for d in (d1, d2):
        if d is not None:
            columns += [(d == v).astype(float) for v in sorted(set(d))[1:]]
    m = np.column_stack(columns)
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    e = y - m @ beta
    bread = np.linalg.pinv(m.T @ m)
    meat = sum(np.outer(s, s) for s in (m[clusters == c].T @ e[clusters == c] for c in set(clusters)))
    g, (n, k) = len(set(clusters)), m.shape
    cov = g / (g - 1) * (n - 1) / (n - k) * bread @ meat @ bread
    e2 = e**2
    fit = m @ np.linalg.lstsq(m, e2, rcond=None)[0]
    lm = n * max(0.0, 1 - ((e2 - fit) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum())
    return beta[1], np.sqrt(cov[1, 1]), 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), lm


def test_unbalanced_models(spark):
    rng = np.random.default_rng(3)
    rows = []
    for a in range(9):
        for year in (2020, 2021, 2022):
            for month in (1, 4, 7):
                if rng.random() < 0.2:
                    continue
                x = rng.normal()
                rows.append((f"a{a}", year, month, f"{year}-{month:02d}-01", float(x), float(3 * x + a + month + rng.normal()), False))
    panel = spark.createDataFrame(rows, "code string, year int, month int, reference_date string, ib double, incidence_0 double, outlier boolean").withColumn("iip", F.col("ib"))
    panel = panel.withColumn("incidence_0", F.col("incidence_0") + 40)
    grid = reg.model_grid(panel, {"iip": fv.OUTLIER_NOT_APPLICABLE, "ib": fv.OUTLIER_EXCLUDED}, lags=0).collect()
    assert len(grid) == 12
    x = np.array([r[4] for r in rows]); x = (x - x.mean()) / x.std()
    y = np.array([r[5] for r in rows]) + 40
    code, year, month, rounds = (np.array([str(r[i]) for r in rows]) for i in (0, 1, 2, 3))
    designs = {"bruto": (None, None), "tempo": (year, month), "municipio_rodada": (code, rounds)}
    for r in grid:
        target = y if r["transform"] == "original" else np.log1p(y)
        beta, error, r2, lm = _dense_model(target, x, *designs[r["adjustment"]], code)
        assert np.allclose([r["coefficient"], r["cluster_error"], r["r_squared"], r["bp_statistic"]], [beta, error, r2, lm], rtol=1e-6)
        assert 0 <= r["p_value"] <= 1 and 0 <= r["bp_p"] <= 1


def test_exact_line(spark):
    rows = [(f"a{i % 4}", float(i), 3.0 * i + 2, "", "") for i in range(12)]
    df = spark.createDataFrame(rows, "code string, x double, y double, c1 string, c2 string").withColumn("spec", F.lit("s"))
    row = reg.clustered_models(df, ["spec"]).first()
    assert np.isclose(row["coefficient"], 3.0) and np.isclose(row["r_squared"], 1.0)


def _grid_edges(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 1.0), ("c", "a", 1.0)]
    return spark.createDataFrame(edges, "src string, dst string, weight double").withColumn("rule", F.lit("r"))


def test_moran_is_reproducible(spark):
    values = spark.createDataFrame([(2020, "a", 1.0), (2020, "b", 2.0), (2020, "c", 4.0)], "year int, code string, value double")
    first = spatial.moran_global(values, _grid_edges(spark), 49).first()
    again = spatial.moran_global(values.repartition(5), _grid_edges(spark).repartition(3), 49).first()
    # the order of a sum may move the last digit of the coefficient, never the p-value
    assert first["p_value"] == again["p_value"] and np.isclose(first["moran_i"], again["moran_i"], rtol=1e-12)
    z = np.array([1.0, 2.0, 4.0]) - 7 / 3
    w = np.array([[0, 0.5, 0.5], [1, 0, 0], [1, 0, 0]])
    assert np.isclose(first["moran_i"], 3 / w.sum() * (z @ w @ z) / (z @ z)) and first["expected"] == -0.5
    local = {r["code"]: r for r in spatial.moran_local(values, _grid_edges(spark), 49).collect()}
    assert np.isclose(local["a"]["local_i"], z[0] * (w @ z)[0] / np.mean(z**2)) and 0 < local["a"]["p_value"] <= 1


def _plain_bijection(n, seed, year, perm):
    from vigipanel.operators.bijection import FACTORS, MERSENNE, PRIME, ROUNDS, TERMS

    beyond, a = min((-(-n // a) * a - n, -a) for a in range(max(2, int(np.ceil(np.sqrt(n) / 2))), max(2, int(np.sqrt(n))) + 1))
    a, b = -a, -(-n // -a)
    u = (seed * 48271 + year * 69621 + perm * 16807) % MERSENNE
    k = (u * u % PRIME * 1103515245 + perm) % PRIME

    def once(p):
        half = [p // b, p % b]
        for r in range(ROUNDS):
            times, plus = 1 + (k * FACTORS[r] + TERMS[r]) % (PRIME - 1), (k * FACTORS[r + ROUNDS] + TERMS[r + ROUNDS]) % PRIME
            half[r % 2] = (half[r % 2] + (half[1 - r % 2] * times + plus) % PRIME) % (a, b)[r % 2]
        return half[0] * b + half[1]

    out = []
    for p in range(n):
        p = once(p)
        while p >= n:
            p = once(p)
        out.append(p)
    return out


def test_permutations_deal_every_value_once(spark):
    """Years of different sizes, small primes among them (positions beyond n walk on); the plan sorts nothing by permutation."""
    sizes = {2020: 50, 2021: 7, 2022: 2, 2023: 53, 2024: 1, -3: 23}
    values = spark.createDataFrame([(y, f"c{i:03d}", float(i * i)) for y, n in sizes.items() for i in range(n)], "year int, code string, value double")
    rows = {(r["year"], r["code"]): r["dealt"] for r in spatial.dealt_values(values, 5, 7, True).collect()}
    for year, n in sizes.items():
        z = np.arange(n) ** 2 - (np.arange(n) ** 2).mean()
        for perm in range(1, 6):
            to = _plain_bijection(n, 7 + year, year, perm)
            assert sorted(to) == list(range(n))
            assert np.allclose([rows[(year, f"c{t:03d}")][perm - 1] for t in to], z)


def test_permutations_are_even():
    """Each position goes everywhere about as often, and neighbours part: 600 permutations of 25 areas."""
    deals = np.array([_plain_bijection(25, 20240729, 2024, p) for p in range(1, 601)])
    for position in range(25):
        seen = np.bincount(deals[:, position], minlength=25)
        assert ((seen - 24) ** 2 / 24).sum() < 60          # chi-square of 24 degrees: 1 in 10,000 beyond 59
    step = np.bincount((deals[:, 1] - deals[:, 0]) % 25, minlength=25)[1:]
    assert ((step - 25) ** 2 / 25).sum() < 58


def test_constant_values_are_reported(spark):
    values = spark.createDataFrame([(2020, c, 1.0) for c in "abc"], "year int, code string, value double")
    assert spatial.moran_global(values, _grid_edges(spark), 9).first()["moran_i"] is None
    assert [r["rule"] for r in dq.spatial_ready(values, _grid_edges(spark)).collect()] == ["spatial_constant"]


def test_nearest_takes_parts_by_points(spark, monkeypatch):
    """The join of cells is dealt by the number of points, not by the few bytes before it."""
    rng = np.random.default_rng(4)
    rows = [(f"{k:03d}", float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 40, (90, 2)))]
    monkeypatch.setattr(neighbours, "_TASK_POINTS", 5)
    found = neighbours.nearest(spark.createDataFrame(rows, "code string, x double, y double"), 4)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["src"], []).append((r["distance"], r["dst"]))
    for code, x, y in rows:
        others = sorted((((a - x) ** 2 + (b - y) ** 2) ** 0.5, other) for other, a, b in rows if other != code)[:4]
        assert [d for _, d in sorted(got[code])] == [d for _, d in others]


@pytest.mark.parametrize("kind", ["scattered", "crowded", "one_place", "few"])
def test_nearest_is_exact(spark, kind):
    rng = np.random.default_rng(11)
    if kind == "scattered":
        xy = rng.random((150, 2)) * [1000, 3]
    elif kind == "crowded":          # a third at one place, a dense cluster, and outliers
        xy = np.vstack([np.full((60, 2), 5.0), 5 + rng.normal(size=(80, 2)) * 1e-4, rng.random((40, 2)) * 1e4])
    elif kind == "one_place":
        xy = np.full((12, 2), 3.0)
    else:
        xy = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 5.0]])
    rows = [(f"p{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    found = neighbours.nearest(spark.createDataFrame(rows, "code string, x double, y double"), 4).collect()
    got = {}
    for r in found:
        got.setdefault(r["src"], set()).add(r["dst"])
    for code, x, y in rows:
        order = sorted(((x - q[1]) * (x - q[1]) + (y - q[2]) * (y - q[2]), q[0]) for q in rows if q[0] != code)
        assert got[code] == {c for _, c in order[:4]}


def test_polygons(spark):
    boxes = {"a": (0, 0, 1, 1), "b": (1, 0, 2, 1), "c": (2, 1, 3, 2), "d": (9, 9, 10, 10)}
    rows = [(k, 0, i, float(x), float(y)) for k, (x0, y0, x1, y1) in boxes.items()
            for i, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
    rings = spark.createDataFrame(rows, "code string, ring int, seq int, x double, y double")
    queen = neighbours.contiguity(rings)
    assert {(r["src"], r["dst"]): r["contact"] for r in queen.collect()} == {
        ("a", "b"): "rook", ("b", "a"): "rook", ("b", "c"): "queen_point", ("c", "b"): "queen_point"}
    assert {r["code"]: (r["cx"], r["cy"]) for r in neighbours.centroids(rings).collect()}["c"] == (2.5, 1.5)
    areas = spark.createDataFrame([(k,) for k in boxes], "code string")
    assert [(r["rule"], r["key"]) for r in dq.neighbour_graph(queen, areas).collect()] == [("graph_isolate", "d")]
    assert {(r["src"], r["weight"]) for r in neighbours.edge_contacts_only(queen).collect()} == {("a", 1.0), ("b", 1.0)}


def test_stocks(spark):
    df = spark.createDataFrame([("s", i, float(c)) for i, c in enumerate([1, 2, 3, 4])] + [("t", i, float(c)) for i, c in enumerate([10, 0, 0])], "k string, t int, c double")
    window = {(r["k"], r["t"]): r["active"] for r in stock.fixed_window_active(df, ["k"], "t", "c", 2).collect()}
    assert [window["s", i] for i in range(4)] == [1, 3, 5, 7]
    flow = {(r["k"], r["t"]): r["active_outflow"] for r in stock.outflow_active(df, ["k"], "t", "c", 0.5).collect()}
    assert [flow["t", i] for i in range(3)] == [10, 5, 2.5]
    with pytest.raises(ValueError):
        stock.fixed_window_active(df, ["k"], "t", "c", 0)
    with pytest.raises(ValueError):
        stock.outflow_active(df, ["k"], "t", "c", 1.5)


def test_assessment(spark):
    rows = [(0.5, True, 5, 1.0), (0.001, False, 0, None), (0.5, True, 5, 9.0)]
    df = spark.createDataFrame(rows, "beta double, converged boolean, validation_size int, validation_rmse double")
    got = [r["reasons"] for r in stock.assess_calibration(df, F.lit(10.0), 0.5, 0.05, 0.0, 1.0).collect()]
    assert got == ["", f"{fv.REASON_NOT_CONVERGED}|{fv.REASON_NO_VALIDATION}|{fv.REASON_BOUND}", fv.REASON_NRMSE]


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0)], "k string, v double")
    got = {(r["k"], r["v"]): r["position"] for r in ranking.row_positions(df, ["k"], ["v"]).collect()}
    assert got == {("a", 1.0): 1, ("a", 2.0): 2, (None, 5.0): 1, (None, 7.0): 2}
    assert {r["k"]: r["m"] for r in ranking.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == {"a": 1.5, None: 6.0}
    pairs = spark.createDataFrame([(None, i, float(i), float(i * i)) for i in range(5)], "k string, id int, x double, y double")
    row = assoc.correlations(pairs, ["k"]).first()
    assert row["k"] is None and row["observations"] == 5 and row["spearman_rho"] == 1.0
    assert assoc.leave_one_out(pairs, ["k"], ["id"]).count() == 5


def test_chain_of_categories(spark):
    """Areas that share one round with the next area only: sweeping means in turn would take hundreds of turns here."""
    rng = np.random.default_rng(12)
    rows = [(spec, f"a{k:02d}", f"a{k:02d}", f"t{t:02d}", float(rng.normal()), float(rng.normal() + k * k + 1e4 * (spec == "t"))) for spec in "st" for k in range(9) for t in (k, k + 1)]
    df = spark.createDataFrame(rows, "spec string, code string, c1 string, c2 string, x double, y double")
    got = {(r["spec"], r["c1"], r["c2"]): (r["x"], r["y"]) for r in reg.absorbed(df, ["spec"], ["x", "y"]).collect()}
    for spec in "st":
        own = [r for r in rows if r[0] == spec]
        design = np.array([[float(r[2] == f"a{k:02d}") for k in range(9)] + [float(r[3] == f"t{k:02d}") for k in range(10)] for r in own])
        for at in (0, 1):
            v = np.array([r[4 + at] for r in own])
            left = v - design @ np.linalg.lstsq(design, v, rcond=None)[0]
            assert np.allclose([got[(spec, r[2], r[3])][at] for r in own], left, atol=1e-8 * np.abs(v).max())


def _plain_touch(p, q):
    """2, 1 or 0 as in the join, in whole numbers."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *p, *q

    def side(ox, oy, px, py, x, y):
        v = (px - ox) * (y - oy) - (py - oy) * (x - ox)
        return (v > 0) - (v < 0)

    def within(px, py, qx, qy, x, y):
        return min(px, qx) <= x <= max(px, qx) and min(py, qy) <= y <= max(py, qy)

    s = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy), side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    if s[0] == s[1] == 0:
        k = 0 if ax != bx else 1
        low, high = max(min(p[0][k], p[1][k]), min(q[0][k], q[1][k])), min(max(p[0][k], p[1][k]), max(q[0][k], q[1][k]))
        return 2 if high > low else 1 if high == low else 0
    on = [s[0] == 0 and within(ax, ay, bx, by, cx, cy), s[1] == 0 and within(ax, ay, bx, by, dx, dy), s[2] == 0 and within(cx, cy, dx, dy, ax, ay), s[3] == 0 and within(cx, cy, dx, dy, bx, by)]
    return 1 if any(on) or (s[0] * s[1] < 0 and s[2] * s[3] < 0) else 0


def test_contacts_of_any_polygons(spark):
    """T-junctions, touching corners, crossings, long sides beside many short ones, against all pairs in whole numbers."""
    import random

    draw = random.Random(6)
    shapes = {"long": [(-100, -5), (300, -5), (300, 0), (-100, 0)], "T1": [(0, 0), (4, 0), (4, 3), (0, 3)], "T2": [(4, 1), (9, 1), (9, 2), (4, 2)], "P": [(9, 2), (12, 2), (12, 9)], "far": [(1000, 1000), (1001, 1000), (1000, 1001)]}
    for k in range(60):
        x, y, size = draw.randint(-20, 40), draw.randint(0, 40), draw.choice([1, 2, 3, 8])
        corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
        shapes[f"s{k}"] = [c for c in corners if len(corners) == 4 or draw.random() < 0.9] if draw.random() < 0.6 else draw.sample(corners, 3)
    rows = [(code, 0, i, float(x), float(y)) for code, ring in shapes.items() for i, (x, y) in enumerate(ring)]
    got = {(r["src"], r["dst"]): r["contact"] for r in neighbours.contiguity(spark.createDataFrame(rows, "code string, ring int, seq int, x double, y double")).collect()}
    want = {}
    for a, one in shapes.items():
        for b, two in shapes.items():
            if a != b:
                best = max(_plain_touch((one[i - 1], one[i]), (two[j - 1], two[j])) for i in range(len(one)) for j in range(len(two)))
                if best:
                    want[(a, b)] = {2: fv.CONTACT_EDGE, 1: fv.CONTACT_POINT}[best]
    assert got == want and want[("T1", "T2")] == want[("long", "T1")] == fv.CONTACT_EDGE and want[("T2", "P")] == fv.CONTACT_POINT


def test_each_pair_of_sides_meets_once(spark):
    """On a mesh of whole numbers, where corners lie on the borders of cells, every side meets only those it touches."""
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    rows = [(f"{x:02d}{y:02d}", 0, i, float(x + dx), float(y + dy)) for x in range(12) for y in range(12) for i, (dx, dy) in enumerate(corners)]
    rings = spark.createDataFrame(rows + rows[:40], "code string, ring int, seq int, x double, y double")      # some rows twice
    met = neighbours.met_sides(rings).select("one", "two", *[f"{s}.{k}" for s in "pq" for k in ("ax", "ay", "bx", "by")]).toDF(*"abcdefghij").collect()
    sides = [(code, (x, y), (x + 1, y)) for code, _, i, x, y in rows if i == 0] + [(code, (x, y), (x, y - 1)) for code, _, i, x, y in rows if i == 3]
    sides += [(code, (x, y), (x, y + 1)) for code, _, i, x, y in rows if i == 1] + [(code, (x, y), (x - 1, y)) for code, _, i, x, y in rows if i == 2]
    want = {frozenset([p, q]) for p in sides for q in sides if p[0] < q[0] and _plain_touch(p[1:], q[1:])}
    got = [frozenset([(r[0], (r[2], r[3]), (r[4], r[5])), (r[1], (r[6], r[7]), (r[8], r[9]))]) for r in met]
    swapped = [frozenset([(r[1], (r[2], r[3]), (r[4], r[5])), (r[0], (r[6], r[7]), (r[8], r[9]))]) for r in met]
    assert len(met) == len(want) and {g if g in want else s for g, s in zip(got, swapped)} == want
    assert neighbours.contiguity(rings).count() == 2 * (11 * 12 * 2 + 11 * 11 * 2)


def test_blocks_add_up_to_the_whole_matrix(spark, monkeypatch):
    """Many blocks of a few areas, two rules, areas without neighbours and a hub, against the dense matrix."""
    monkeypatch.setattr(spatial, "_CELLS", 40)
    monkeypatch.setattr(spatial, "_DEALT", 60)
    rng = np.random.default_rng(4)
    n, permutations = 31, 19
    codes = [f"c{i:02d}" for i in range(n)]
    value = rng.integers(0, 9, n).astype(float)
    edges, want = [], {}
    for rule in "qr":
        links = {(0, j) for j in range(1, 25)} | {(int(a), int(b)) for a, b in rng.integers(0, 28, (60, 2)) if a != b}
        w = np.zeros((n, n))
        for a, b in links:
            w[a, b] = 1 / sum(s == a for s, _ in links)
        edges += [(rule, codes[a], codes[b], float(w[a, b])) for a, b in links]
        z = value - value.mean()
        own, hits, local_hits = n * (z @ w @ z) / (w.sum() * (z @ z)), 0, np.zeros(n)
        for perm in range(1, permutations + 1):
            dealt = np.empty(n)
            dealt[_plain_bijection(n, 7, 2020, perm)] = z
            hits += round(abs(n * (dealt @ w @ dealt) / (w.sum() * (z @ z))), 12) >= round(abs(own), 12)
            local_hits += np.abs(dealt * (w @ dealt) / (z @ z / n)).round(12) >= np.abs(z * (w @ z) / (z @ z / n)).round(12)
        want[rule] = (own, (hits + 1) / (permutations + 1), (local_hits + 1) / (permutations + 1), w.any(axis=1))
    values = spark.createDataFrame([(2020, c, float(v)) for c, v in zip(codes, value)], "year int, code string, value double")
    graph = spark.createDataFrame(edges, "rule string, src string, dst string, weight double")
    for r in spatial.moran_global(values, graph, permutations, 7).collect():
        assert np.isclose(r["moran_i"], want[r["rule"]][0]) and np.isclose(r["p_value"], want[r["rule"]][1])
    local = {(r["rule"], r["code"]): r["p_value"] for r in spatial.moran_local(values, graph, permutations, 7).collect()}
    assert set(local) == {(rule, codes[i]) for rule in "qr" for i in np.flatnonzero(want[rule][3])}
    assert all(np.isclose(p, want[rule][2][codes.index(code)]) for (rule, code), p in local.items())


def test_permutations_undone():
    for n in (1, 2, 3, 7, 50, 1000):
        root = int(n ** 0.5)
        a = max(2, root)
        b = -(-n // a)
        key = bijection.keys(5, 2001, np.arange(1, 8))
        to = bijection.dealt(np.arange(n), n, a, b, key)
        back = bijection.drawn(np.arange(n), n, a, b, key)
        for there, here in zip(to, back):
            assert sorted(there) == list(range(n)) and (here[there] == np.arange(n)).all()


@pytest.mark.parametrize("cells, dealt", [(1 << 19, 1 << 21), (200, 90)])
def test_moran_without_written_permutations(spark, monkeypatch, cells, dealt):
    """Dealt values are looked up in tasks; they are exchanged only beyond a bound, with the same results."""
    draw = np.random.default_rng(3)
    values = spark.createDataFrame([(year, f"{k:03d}", float(draw.integers(0, 6))) for year in (2001, 2002) for k in range(60)] + [(2002, "007", 3.0)], "year long, code string, value double")
    ends = sorted({tuple(x) for x in draw.integers(0, 58, (300, 2)).tolist() if x[0] != x[1]}) + [(0, k) for k in range(1, 58)]
    edges = spark.createDataFrame([(rule, f"{a:03d}", f"{b:03d}", 0.25) for rule, part in (("x", ends), ("y", ends[:40])) for a, b in part], "rule string, src string, dst string, weight double")
    monkeypatch.setattr(spatial, "_CELLS", cells)
    monkeypatch.setattr(spatial, "_DEALT", dealt)
    monkeypatch.setattr(spatial, "_PIECE", 25)

    def results():
        found = [spatial.moran_global(values, edges, 19), spatial.moran_global(values, edges, 19, seed_plus_year=True), spatial.moran_local(values, edges, 19)]
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()) for f in found]

    with monkeypatch.context() as patched:
        patched.setattr(spatial, "_dealt_blocks", lambda *a: pytest.fail("dealt values are written"))
        looked_up = results()
    monkeypatch.setattr(spatial, "_HELD", 100)
    assert results() == looked_up and all(len(f) >= 4 for f in looked_up)
