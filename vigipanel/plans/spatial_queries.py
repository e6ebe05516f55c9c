"""Neighbour graphs and spatial autocorrelation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from vigipanel import fixed_values as fv
from vigipanel.operators import neighbours, spatial
from vigipanel.plans.comparison_bijection import bijection_walk, dealt_by
from vigipanel.plans.registry import query
from vigipanel.plans.views import whole

PERMUTATIONS = fv.PERMUTATIONS


def _edges(v, *rules):
    tables = {"queen": lambda: v.queen, "rook": lambda: v.rook, "knn4": lambda: v.knn4}
    frames = [tables[r]().select("rule", "src", "dst", "weight") for r in rules]
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("contiguity_queen", """
SELECT src, dst, contact, neighbours, CAST(1 AS BIGINT) AS binary_weight, round(weight, 6) + 0.0 AS weight, 'contiguidade_rainha' AS rule FROM mesh_edge""")
def contiguity_queen(v):
    return whole(neighbours.contiguity(v.customer_mesh))


@query("contiguity_rook", """
SELECT src, dst, contact, count(*) OVER (PARTITION BY src) AS neighbours, CAST(1 AS BIGINT) AS binary_weight,
  round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY src), 6) + 0.0 AS weight, 'contiguidade_torre' AS rule FROM mesh_edge WHERE contact = 'rook'""")
def contiguity_rook(v):
    return whole(neighbours.edge_contacts_only(neighbours.contiguity(v.customer_mesh)))


@query("contiguity_bricks", """
WITH b AS (SELECT code, x + CASE WHEN y % 2 = 1 THEN 0.5 ELSE 0 END AS x, y FROM mesh)
SELECT a.code AS src, o.code AS dst, CASE WHEN a.y = o.y OR abs(a.x - o.x) < 1 THEN 'rook' ELSE 'queen_point' END AS contact,
  count(*) OVER (PARTITION BY a.code) AS neighbours, CAST(1 AS BIGINT) AS binary_weight, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY a.code), 6) + 0.0 AS weight,
  'contiguidade_rainha' AS rule
FROM b a JOIN b o ON o.y BETWEEN a.y - 1 AND a.y + 1 AND o.x BETWEEN a.x - 1 AND a.x + 1 AND a.code <> o.code""")
def contiguity_bricks(v):
    """Every second row shifted by half a side: contacts along a part of an edge, with no common vertex on one side."""
    shift = F.when(F.floor("y0") % 2 == 1, 0.5).otherwise(0.0)
    base = v.customer_mesh.withColumn("y0", F.min("y").over(Window.partitionBy("code")))
    return whole(neighbours.contiguity(base.withColumn("x", F.col("x") + shift).drop("y0")))


@query("neighbour_counts", """
SELECT src, count(*) AS neighbours, count(*) FILTER (WHERE contact = 'rook') AS by_edge, round(sum(weight), 6) + 0.0 AS weight_sum FROM mesh_edge GROUP BY 1""")
def neighbour_counts(v):
    return whole(neighbours.contiguity(v.customer_mesh).groupBy("src").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count_if(F.col("contact") == fv.CONTACT_EDGE).alias("by_edge"),
        F.sum("weight").alias("weight_sum"),
    ))


@query("knn4", """
SELECT src, dst, contact, round(distance, 6) + 0.0 AS distance, CAST(1 AS BIGINT) AS binary_weight, weight, neighbours, rule FROM knn4_edge""")
def knn4(v):
    return whole(v.knn4)


@query("knn4_points", """
WITH d AS (SELECT a.p_partkey AS src, b.p_partkey AS dst,
    (b.p_size - a.p_size) * CAST(b.p_size - a.p_size AS DOUBLE) + (b.p_retailprice - a.p_retailprice) * (b.p_retailprice - a.p_retailprice) AS d2
  FROM part a JOIN part b ON a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM d)
SELECT src, dst, round(sqrt(d2), 6) + 0.0 AS distance FROM r WHERE r <= 4""")
def knn4_points(v):
    """Parts as points (size, price): a table that grows, with crowded places and ties."""
    points = v.table("part").select(
        F.col("p_partkey").alias("code"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")
    )
    return whole(neighbours.nearest(points, 4).select("src", "dst", "distance"))


@query("centroids", "SELECT code, x + 0.5 AS cx, y + 0.5 AS cy FROM mesh")
def centroids(v):
    return whole(neighbours.centroids(v.customer_mesh))


@query("moran_customers", """
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT m.code, CAST(coalesce(o.n, 0) AS DOUBLE) AS value FROM mesh m LEFT JOIN o ON lpad(CAST(o.o_custkey AS VARCHAR), 9, '0') = m.code),
z AS (SELECT CAST(2000 AS BIGINT) AS year, code, value - avg(value) OVER () AS z, count(*) OVER () AS n, row_number() OVER (ORDER BY code) AS position FROM c),
walk AS (""" + bijection_walk("SELECT year, perm, code, z, n, position - 1 AS p, 20240729 AS seed FROM z, (SELECT unnest(generate_series(1, 999)) AS perm)", "walk") + """),
d AS (SELECT perm, code, z, n FROM (""" + dealt_by("walk", "z") + """) UNION ALL SELECT 0, code, z, n FROM z),
l AS (SELECT s.perm, s.code, s.z, s.n, sum(e.weight * t.z) AS lag FROM d s JOIN mesh_edge e ON e.src = s.code JOIN d t ON t.code = e.dst AND t.perm = s.perm GROUP BY ALL),
i AS (SELECT perm, count(*) AS areas, max(n) * sum(z * lag) / (count(*) * sum(z * z)) AS i FROM l GROUP BY 1)
SELECT CAST(2000 AS BIGINT) AS year, max(areas) AS areas, round(max(CASE WHEN perm = 0 THEN i END), 6) + 0.0 AS moran_i,
  round((count(*) FILTER (WHERE perm > 0 AND round(abs(i), 12) >= (SELECT round(abs(i), 12) FROM i WHERE perm = 0)) + 1) / 1000.0, 6) + 0.0 AS p_value FROM i""")
def moran_customers(v):
    """Orders per customer on the customer mesh: many areas, many equal values."""
    orders = v.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    people = v.table("customer").select("c_custkey")
    values = people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.lit(2000).alias("year"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"),
        F.coalesce("n", F.lit(0)).cast("double").alias("value"),
    )
    return whole(spatial.moran_global(values, neighbours.contiguity(v.customer_mesh), PERMUTATIONS).select("year", "areas", "moran_i", "p_value"))


@query("spatial_lag", """
SELECT rule, year, code, round(value, 6) + 0.0 AS value, round(z, 6) + 0.0 AS z, round(lag, 6) + 0.0 AS lag FROM lagged WHERE rule = 'contiguidade_rainha'""")
def spatial_lag(v):
    return whole(spatial.spatial_lag(v.incidence_values, _edges(v, "queen")).select("rule", "year", "code", "value", "z", "lag"))


SIMULATED = """
WITH sim AS (SELECT e.rule, d.year, d.perm, d.code, d.z, d.n, sum(e.weight * o.z) AS lag FROM {deal} d
  JOIN all_edges e ON e.src = d.code JOIN {deal} o ON o.code = e.dst AND o.year = d.year AND o.perm = d.perm {filter} GROUP BY ALL),
total AS (SELECT sim.rule, sim.year, perm, max(n) * sum(z * lag) / (count(*) * max(zz)) AS i FROM sim JOIN squares s ON s.year = sim.year GROUP BY 1, 2, 3),
p AS (SELECT t.rule, t.year, (count(*) FILTER (WHERE round(abs(t.i), 12) >= round(abs(o.moran_i), 12)) + 1) / 1000.0 AS p
  FROM total t JOIN observed_global o ON o.rule = t.rule AND o.year = t.year GROUP BY 1, 2)
"""


@query("moran_global", SIMULATED.format(deal="deal_global", filter="WHERE e.rule = 'contiguidade_rainha'") + """
SELECT o.year, o.areas, round(o.moran_i, 6) + 0.0 AS moran_i, round(-1.0 / (o.areas - 1), 6) + 0.0 AS expected, round(CAST(p AS DOUBLE), 6) + 0.0 AS p_value,
  CAST(999 AS BIGINT) AS permutations, o.rule, CAST(20240729 AS BIGINT) AS seed FROM observed_global o JOIN p ON p.rule = o.rule AND p.year = o.year""")
def moran_global(v):
    return whole(spatial.moran_global(v.incidence_values, _edges(v, "queen"), PERMUTATIONS))


@query("moran_sensitivity", SIMULATED.format(deal="deal_yearly", filter="") + """
SELECT o.year, o.rule, round(o.moran_i, 6) + 0.0 AS moran_i, round(CAST(p AS DOUBLE), 6) + 0.0 AS p_value, CAST(999 AS BIGINT) AS permutations,
  CAST(20240729 + o.year AS BIGINT) AS seed FROM observed_global o JOIN p ON p.rule = o.rule AND p.year = o.year""")
def moran_sensitivity(v):
    return whole(
        spatial.moran_global(v.incidence_values, _edges(v, "queen", "rook", "knn4"), PERMUTATIONS, seed_plus_year=True)
        .select("year", "rule", "moran_i", "p_value", "permutations", "seed")
    )


@query("moran_local", """
WITH sim AS (SELECT d.year, d.perm, d.code, d.z, sum(e.weight * o.z) AS lag FROM deal_global d
  JOIN queen_edge e ON e.src = d.code JOIN deal_global o ON o.code = e.dst AND o.year = d.year AND o.perm = d.perm GROUP BY ALL),
obs AS (SELECT *, z * lag / (zz / n) AS i FROM lagged WHERE rule = 'contiguidade_rainha'),
p AS (SELECT o.year, o.code, (count(*) FILTER (WHERE round(abs(s.z * s.lag / (o.zz / o.n)), 12) >= round(abs(o.i), 12)) + 1) / 1000.0 AS p
  FROM sim s JOIN obs o ON o.year = s.year AND o.code = s.code GROUP BY 1, 2)
SELECT o.code, o.year, round(o.value, 6) + 0.0 AS value, round(o.z, 6) + 0.0 AS z, round(o.lag, 6) + 0.0 AS lag, round(o.i, 6) + 0.0 AS local_i,
  round(CAST(p.p AS DOUBLE), 6) + 0.0 AS p_value, CASE WHEN p.p >= 0.05 THEN 'não significativo' WHEN z > 0 AND lag > 0 THEN 'alto-alto' WHEN z < 0 AND lag < 0 THEN 'baixo-baixo'
  WHEN z > 0 AND lag < 0 THEN 'alto-baixo' WHEN z < 0 AND lag > 0 THEN 'baixo-alto' ELSE 'indefinido' END AS cluster,
  CAST(999 AS BIGINT) AS permutations, o.rule FROM obs o JOIN p ON p.year = o.year AND p.code = o.code""")
def moran_local(v):
    return whole(spatial.moran_local(v.incidence_values, _edges(v, "queen"), PERMUTATIONS))


@query("moran_weights_wide", """
SELECT year, round(max(CASE WHEN rule = 'contiguidade_rainha' THEN moran_i END), 6) + 0.0 AS queen,
  round(max(CASE WHEN rule = 'contiguidade_torre' THEN moran_i END), 6) + 0.0 AS rook, round(max(CASE WHEN rule = 'k_vizinhos_4' THEN moran_i END), 6) + 0.0 AS knn4
FROM observed_global GROUP BY 1""")
def moran_weights_wide(v):
    """Coefficients of the three weight rules side by side."""
    from vigipanel.operators.summary import pivoted

    observed = spatial.observed_coefficients(v.incidence_values, _edges(v, "queen", "rook", "knn4"))
    return whole(pivoted(observed, ["year"], "rule", "moran_i", {fv.QUEEN: "queen", fv.ROOK: "rook", "k_vizinhos_4": "knn4"}))
