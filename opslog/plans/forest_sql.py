"""The isolation forest in SQL: its draws are md5 hashes, so both engines grow the same trees."""

from __future__ import annotations

from opslog.operators.iforest import CONSTANT, CONTAMINATION, EULER_GAMMA, FEATURE_SHARE, SAMPLE, SEED, TREES, UNITS

#: A tree over at most ``SAMPLE`` rows has as many levels of splits.
LEVELS = (SAMPLE - 1).bit_length()

#: Mean path length of a search among n points.
PATH = "(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + " + repr(EULER_GAMMA) + \
    ") - 2.0 * ({n} - 1.0) / {n} END)"


def grown() -> str:
    """CTEs ``splits`` and ``leaves`` from ``f`` (block_id, idx, value), ``v`` (terms) and ``stats`` (blocks)."""
    out = [f"""
cells AS MATERIALIZED (SELECT block_id, cast(idx AS bigint) AS idx, cast(cast(value AS float) AS double) AS x FROM f),
dims AS MATERIALIZED (SELECT d, n, least({SAMPLE}, n) AS psi, greatest(1, cast(floor({FEATURE_SHARE} * d) AS bigint)) AS width,
  greatest(1, cast(ceil(log2(greatest(least({SAMPLE}, n), 2))) AS bigint)) AS deepest
  FROM (SELECT (SELECT count(*) FROM v) + 2 AS d, (SELECT count(*) FROM stats) AS n)),
trees AS (SELECT unnest(range({TREES})) AS tree),
allowed AS MATERIALIZED (SELECT tree, idx FROM trees, (SELECT unnest(range((SELECT d FROM dims))) AS idx)
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5('{SEED}:' || tree || ':f:' || idx), idx) <= (SELECT width FROM dims)),
s0 AS MATERIALIZED (SELECT tree, 1 AS node, block_id FROM trees, stats
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY substr(md5('{SEED}:' || tree || ':' || block_id), 1, 15), block_id) <= (SELECT psi FROM dims))"""]
    for level in range(LEVELS + 1):
        out.append(f"""
z{level} AS MATERIALIZED (SELECT tree, node, count(*) AS size FROM s{level} GROUP BY tree, node),
c{level} AS (SELECT s.tree, s.node, a.idx, count(*) AS k, min(x) AS low, max(x) AS high FROM s{level} s JOIN cells USING (block_id)
  JOIN allowed a ON a.tree = s.tree AND a.idx = cells.idx GROUP BY s.tree, s.node, a.idx),
o{level} AS (SELECT tree, node, idx, CASE WHEN k < size THEN least(low, 0) ELSE low END AS low,
  CASE WHEN k < size THEN greatest(high, 0) ELSE high END AS high
  FROM c{level} JOIN z{level} USING (tree, node) WHERE size > 1 AND {level} < (SELECT deepest FROM dims)),
p{level} AS MATERIALIZED (SELECT tree, node, idx, CASE WHEN cut >= high THEN low ELSE cut END AS cut FROM (
  SELECT *, low + cast('0x' || substr(md5('{SEED}:' || tree || ':' || node), 1, 13) AS bigint) / 4503599627370496.0 * (high - low) AS cut
  FROM o{level} WHERE high - low > {CONSTANT!r}
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5('{SEED}:' || tree || ':' || node || ':' || idx), idx) = 1))""")
        if level < LEVELS:
            out.append(f"""
s{level + 1} AS MATERIALIZED (SELECT s.tree, 2 * s.node + CASE WHEN coalesce(x, 0) <= cut THEN 0 ELSE 1 END AS node, s.block_id
  FROM s{level} s JOIN p{level} p ON p.tree = s.tree AND p.node = s.node LEFT JOIN cells ON cells.block_id = s.block_id AND cells.idx = p.idx)""")
    levels = range(LEVELS + 1)
    out.append("\nsplits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in levels) + ")")
    out.append("\nleaves AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT tree, node, {i} AS depth, size FROM z{i} ANTI JOIN p{i} USING (tree, node)" for i in levels) + ")")
    return ",".join(out)


def scored(name: str, key: str, source: str) -> str:
    """CTE ``name`` (``key``, ``score_sample``) for the rows of ``source`` (``key``, idx, x), all rows in ``{source}_rows``."""
    out = [f"\n{name}_w0 AS MATERIALIZED (SELECT {key}, tree, 1 AS node FROM {source}_rows, trees)"]
    for level in range(LEVELS):
        out.append(f"""
{name}_w{level + 1} AS MATERIALIZED (SELECT w.{key}, w.tree, 2 * w.node + CASE WHEN coalesce(x, 0) <= cut THEN 0 ELSE 1 END AS node
  FROM {name}_w{level} w JOIN splits p ON p.tree = w.tree AND p.node = w.node LEFT JOIN {source} c ON c.{key} = w.{key} AND c.idx = p.idx)""")
    every = " UNION ALL ".join(f"SELECT * FROM {name}_w{i}" for i in range(LEVELS + 1))
    out.append(f"""
{name} AS MATERIALIZED (SELECT {key}, -pow(2.0, -(sum(depth * {UNITS} + cast(round({PATH.format(n='size')} * {UNITS}) AS bigint)) / ({UNITS}.0 * {TREES}))
  / (SELECT {PATH.format(n='psi')} FROM dims)) AS score_sample FROM ({every}) JOIN leaves USING (tree, node) GROUP BY {key})""")
    return ",".join(out)


OFFSET = f"""
ordered AS (SELECT score_sample, row_number() OVER (ORDER BY score_sample, block_id) - 1 AS place, {CONTAMINATION} * (count(*) OVER () - 1) AS spot
  FROM trained),
edge AS (SELECT max(CASE WHEN place = floor(spot) THEN score_sample END) AS low, max(CASE WHEN place = ceil(spot) THEN score_sample END) AS high,
  max(spot - floor(spot)) AS part FROM ordered),
threshold AS (SELECT low + (high - low) * part AS edge FROM edge)"""
