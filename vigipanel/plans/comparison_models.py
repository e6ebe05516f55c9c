"""Comparison SQL of the panel regressions: the dummies' system is set up and solved, not swept out.

Effects of the first category leave by its means, which is exact; what is left
is one equation per level of the second category but the first, solved by
Gauss-Jordan steps on a list of rows.  Samples may be unbalanced.
"""

from __future__ import annotations

ADJUSTED = {"bruto": ("''", "''"), "tempo": ("yr", "mo"), "municipio_rodada": ("code", "rd")}


def _absorbed(rows: str, columns: str, out: str) -> str:
    """CTEs that end in ``out``: the columns of ``rows(sp, c1, c2, ...)`` without the effects of c1 and c2, as r_<column>."""
    n = {c: f"sum(r.{c} - n1.m_{c}) AS t_{c}" for c in columns}
    return f"""
{out}_n1 AS (SELECT sp, c1, CAST(count(*) AS DOUBLE) AS n1, {', '.join(f'avg({c}) AS m_{c}' for c in columns)} FROM {rows} GROUP BY 1, 2),
{out}_level AS (SELECT sp, c2, n2, dense_rank() OVER (PARTITION BY sp ORDER BY c2) - 1 AS i FROM (SELECT sp, c2, count(*) AS n2 FROM {rows} GROUP BY 1, 2)),
{out}_cell AS (SELECT r.sp, r.c1, l.i, CAST(count(*) AS DOUBLE) AS n, {', '.join(n.values())} FROM {rows} r JOIN {out}_n1 n1 ON n1.sp = r.sp AND n1.c1 = r.c1
  JOIN {out}_level l ON l.sp = r.sp AND l.c2 = r.c2 WHERE l.i > 0 GROUP BY 1, 2, 3),
{out}_met AS (SELECT a.sp, a.i, b.i AS j, sum(a.n * b.n / n1.n1) AS v FROM {out}_cell a JOIN {out}_cell b ON b.sp = a.sp AND b.c1 = a.c1
  JOIN {out}_n1 n1 ON n1.sp = a.sp AND n1.c1 = a.c1 GROUP BY 1, 2, 3),
{out}_right AS (SELECT sp, i, {', '.join(f'sum(t_{c}) AS t_{c}' for c in columns)} FROM {out}_cell GROUP BY 1, 2),
{out}_equation AS (SELECT l.sp, l.i, list(CASE WHEN l.i = k.i THEN l.n2 ELSE 0 END - coalesce(v, 0.0) ORDER BY k.i) || [{', '.join(f'any_value(t_{c})' for c in columns)}] AS e
  FROM {out}_level l JOIN {out}_level k ON k.sp = l.sp AND k.i > 0 JOIN {out}_right t ON t.sp = l.sp AND t.i = l.i
  LEFT JOIN {out}_met m ON m.sp = l.sp AND m.i = l.i AND m.j = k.i WHERE l.i > 0 GROUP BY 1, 2),
{out}_step AS (
  SELECT sp, 1 AS k, list(e ORDER BY i) AS m FROM {out}_equation GROUP BY 1
  UNION ALL SELECT sp, k + 1, list_transform(m, lambda e, i: CASE WHEN i = k THEN list_transform(e, lambda v: v / m[k][k])
    ELSE list_transform(e, lambda v, j: v - e[k] * m[k][j] / m[k][k]) END) FROM {out}_step WHERE k <= len(m)),
{out}_effect AS (SELECT sp, i, {', '.join(f'm[i][len(m) + {k + 1}] AS g_{c}' for k, c in enumerate(columns))}
  FROM (SELECT sp, m, unnest(range(1, len(m) + 1)) AS i FROM {out}_step WHERE k = len(m) + 1)),
{out} AS (SELECT *, {', '.join(f'v_{c} - avg(v_{c}) OVER (PARTITION BY sp, c1) AS r_{c}' for c in columns)} FROM (
  SELECT r.*, {', '.join(f'r.{c} - coalesce(g_{c}, 0) AS v_{c}' for c in columns)} FROM {rows} r JOIN {out}_level l ON l.sp = r.sp AND l.c2 = r.c2
  LEFT JOIN {out}_effect g ON g.sp = r.sp AND g.i = l.i))"""


def t_tail(r: str, power: str) -> str:
    """Two-sided tail as an integral of cos(theta)**power from asin(|r|) to pi/2, Simpson's rule."""
    a, h = f"asin(abs({r}))", f"((pi() / 2 - asin(abs({r}))) / 2000)"
    beta = f"exp(lgamma(({power}) / 2.0 + 1) - lgamma(0.5) - lgamma((({power}) + 1) / 2.0))"
    return (f"2 * {beta} * {h} / 3 * (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
            f" * pow(abs(cos({a} + i * {h})), {power})) FROM (SELECT unnest(generate_series(0, 2000)) AS i))")


def chi2_tail(x: str, df: str) -> str:
    """Upper tail by the series of the lower incomplete gamma function."""
    half, a = f"({x} / 2)", f"({df} / 2.0)"
    return (f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - (SELECT sum(exp(({a} + i) * ln({half}) - {half} - lgamma({a} + i + 1)))"
            f" FROM (SELECT unnest(generate_series(0, 4000)) AS i))) END")


def model_sql(select: str, where: str, transforms: tuple[str, ...], adjustments: tuple[str, ...]) -> str:
    """``select`` from the models (alias m) of every sample, transform and adjustment."""
    y = {"original": "y", "log1p": "ln(1 + y)"}
    shaped = " UNION ALL ".join(f"SELECT *, '{t}' AS transform, {y[t]} AS z FROM s" for t in transforms)
    spec = " UNION ALL ".join(
        f"SELECT indicator || '|' || lag || '|' || transform || '|{a}' AS sp, indicator, lag, transform, '{a}' AS adjustment, code, {ADJUSTED[a][0]} AS c1, {ADJUSTED[a][1]} AS c2, x, z AS y FROM o"
        for a in adjustments)
    return f"""WITH RECURSIVE s AS (
  SELECT indicator, lag, code, CAST(year AS VARCHAR) AS yr, CAST(month AS VARCHAR) AS mo, CAST(reference_date AS VARCHAR) AS rd, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, y
  FROM panel_pairs WHERE {where} WINDOW w AS (PARTITION BY indicator, lag)),
o AS ({shaped}), row_of AS ({spec}), {_absorbed('row_of', 'xy', 'left_over')},
slope AS (SELECT sp, sum(r_x * r_x) AS xx, sum(r_x * r_y) / sum(r_x * r_x) AS beta FROM left_over GROUP BY 1),
resid AS (SELECT l.sp, l.code, l.c1, l.c2, l.r_x AS x, l.y, l.r_y - beta * l.r_x AS e, pow(l.r_y - beta * l.r_x, 2) AS q FROM left_over l JOIN slope b ON b.sp = l.sp),
meat AS (SELECT sp, sum(w * w) AS meat, count(*) AS g FROM (SELECT sp, code, sum(x * e) AS w FROM resid GROUP BY 1, 2) GROUP BY 1),
fit AS (SELECT sp, count(*) AS n, count(DISTINCT c1) + count(DISTINCT c2) AS k, sum(q) AS rss, var_pop(y) * count(*) AS tss FROM resid GROUP BY 1), {_absorbed('resid', 'q', 'squared')},
aux_slope AS (SELECT sp, sum(x * r_q) / sum(x * x) AS b FROM squared GROUP BY 1),
aux AS (SELECT t.sp, sum(pow(r_q - b * x, 2)) / (var_pop(q) * count(*)) AS left_part FROM squared t JOIN aux_slope a ON a.sp = t.sp GROUP BY 1),
m AS (SELECT d.*, beta, meat.g, fit.n, fit.k, 1 - rss / tss AS r2, sqrt(CAST(g AS DOUBLE) / (g - 1) * (n - 1) / (n - k) * meat) / xx AS se, n * greatest(0.0, 1 - left_part) AS bp
  FROM (SELECT DISTINCT sp, indicator, lag, transform, adjustment FROM row_of) d JOIN slope ON slope.sp = d.sp JOIN meat ON meat.sp = d.sp JOIN fit ON fit.sp = d.sp JOIN aux ON aux.sp = d.sp)
SELECT {select} FROM m"""


T_P = "round(" + t_tail("(beta / sqrt((g - 1) * se * se + beta * beta))", "(g - 2)") + ", 6) + 0.0"
BP_P = "round(" + chi2_tail("bp", "greatest(1, k - 1)") + ", 6) + 0.0"
