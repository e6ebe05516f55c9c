"""The keyed permutations of ``operators.bijection`` as recursive SQL, one half round at a time."""

from __future__ import annotations

from vigipanel.operators.bijection import FACTORS, MERSENNE, PRIME, ROUNDS, TERMS


def bijection_walk(source: str, name: str) -> str:
    """Body of the recursive CTE ``name`` over ``source(year, perm, code, z, n, p, seed)``, p a position from 0."""
    at = f"(t % {ROUNDS} + 1)"
    times = f"(1 + (k * {FACTORS}[{at}] + {TERMS}[{at}]) % {PRIME - 1})"
    plus = f"((k * {FACTORS}[{at} + {ROUNDS}] + {TERMS}[{at} + {ROUNDS}]) % {PRIME})"
    return f"""
SELECT year, perm, z, CAST(n AS BIGINT) AS n, a, b, k, CAST(0 AS BIGINT) AS t, CAST(p // b AS BIGINT) AS l, CAST(p % b AS BIGINT) AS r FROM (
  SELECT s.*, c.a, (s.n + c.a - 1) // c.a AS b, ((u * u) % {PRIME} * 1103515245 + perm) % {PRIME} AS k
  FROM (SELECT *, ((CAST(seed AS BIGINT) * 48271 + year * 69621 + perm * 16807) % {MERSENNE} + {MERSENNE}) % {MERSENNE} AS u FROM ({source})) s
  JOIN (SELECT n, arg_min(a, (((n + a - 1) // a) * a - n, -a)) AS a FROM (
    SELECT n, CAST(unnest(generate_series(CAST(greatest(2, ceil(sqrt(n) / 2)) AS BIGINT), CAST(greatest(2, floor(sqrt(n))) AS BIGINT))) AS BIGINT) AS a FROM (SELECT DISTINCT n FROM ({source}))
  ) GROUP BY n) c ON c.n = s.n)
UNION ALL
SELECT year, perm, z, n, a, b, k, t + 1, CASE WHEN t % 2 = 0 THEN (l + (r * {times} + {plus}) % {PRIME}) % a ELSE l END,
  CASE WHEN t % 2 = 1 THEN (r + (l * {times} + {plus}) % {PRIME}) % b ELSE r END
FROM {name} WHERE t = 0 OR t % {ROUNDS} <> 0 OR l * b + r >= n"""


def dealt_by(walk: str, areas: str = "centred") -> str:
    """``year, perm, code, z, n``: what the walk deals to each area."""
    return f"""
SELECT w.year, w.perm, c.code, w.z, w.n FROM {walk} w JOIN {areas} c ON c.year = w.year AND c.position = w.l * w.b + w.r + 1
WHERE w.t > 0 AND w.t % {ROUNDS} = 0 AND w.l * w.b + w.r < w.n"""
