"""Common table expressions of the SQL that checks the queries."""

from __future__ import annotations

from quakeloom.params import DEFAULT, EARTH_KM, YEAR_SECONDS
from quakeloom.sources.derived import CATALOG_SQL

P = DEFAULT
CATALOG = "catalog AS MATERIALIZED (" + CATALOG_SQL.replace("{epoch_us}", "epoch_us").replace("{events}", "events") + ")"
KEPT = f"{CATALOG}, kept AS MATERIALIZED (SELECT * FROM catalog WHERE magnitude >= {P.m_c!r}::DOUBLE)"


def km(a: str, b: str) -> str:
    """Distance of the rows with these aliases."""
    up = f"sin((radians({b}.latitude) - radians({a}.latitude)) / 2e0)"
    across = f"sin((radians({b}.longitude) - radians({a}.longitude)) / 2e0)"
    return f"CASE WHEN {a}.latitude + {b}.latitude IS NOT NULL THEN {2 * EARTH_KM!r}::DOUBLE * asin(sqrt(least(1e0, greatest(0e0, {up} * {up} + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * {across} * {across})))) END"


def r6(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits}"


LINKED = f"""{KEPT},
pairs AS (SELECT j.event_id, i.event_id AS parent_id, log10((j.sort_time - i.sort_time) / {YEAR_SECONDS!r}::DOUBLE) AS lt, {km("j", "i")} AS d, i.magnitude AS pm
  FROM kept j JOIN kept i ON i.sort_time < j.sort_time),
par AS (SELECT event_id, arg_min(parent_id, lt + {P.d_f!r}::DOUBLE * log10(d) - {P.b!r}::DOUBLE * pm) AS parent_id FROM pairs WHERE d > 0 GROUP BY event_id),
joined AS (SELECT j.*, par.parent_id, j.sort_time - i.sort_time AS gap_seconds, {km("j", "i")} AS distance_km, i.magnitude AS parent_magnitude, i.depth_km AS parent_depth_km
  FROM kept j LEFT JOIN par USING (event_id) LEFT JOIN kept i ON i.event_id = par.parent_id),
eta AS (SELECT *, log10(gap_seconds / {YEAR_SECONDS!r}::DOUBLE) + {P.d_f!r}::DOUBLE * log10(distance_km) - {P.b!r}::DOUBLE * parent_magnitude AS log10_eta FROM joined),
linked AS MATERIALIZED (SELECT *, coalesce(log10_eta < {P.log10_eta0!r}::DOUBLE, false) AS is_strong FROM eta)"""

CLUSTERED = f"""{LINKED},
up(event_id, root, depth) AS (SELECT event_id, event_id, 0 FROM linked WHERE NOT is_strong
  UNION ALL SELECT l.event_id, up.root, up.depth + 1 FROM linked l JOIN up ON l.parent_id = up.event_id WHERE l.is_strong),
rooted AS MATERIALIZED (SELECT l.*, up.root, up.depth FROM linked l JOIN up USING (event_id)),
grouped AS (SELECT root, count(*) AS cluster_size, min((sort_time, event_id)) AS first_member FROM rooted GROUP BY root),
numbered AS (SELECT root, cluster_size, row_number() OVER (ORDER BY first_member) AS cluster_id FROM grouped),
heads AS (SELECT root, event_id AS mainshock_id, sort_time AS mainshock_time, magnitude AS mainshock_magnitude FROM rooted
  QUALIFY row_number() OVER (PARTITION BY root ORDER BY magnitude DESC, sort_time, event_id) = 1),
roles AS (SELECT r.*, n.cluster_id, n.cluster_size, h.mainshock_id, h.mainshock_time, h.mainshock_magnitude,
  CASE WHEN cluster_size = 1 THEN 'single' WHEN r.event_id = mainshock_id THEN 'mainshock' WHEN r.sort_time < mainshock_time THEN 'foreshock' ELSE 'aftershock' END AS event_role
  FROM rooted r JOIN numbered n USING (root) JOIN heads h USING (root)),
clustered AS MATERIALIZED (SELECT event_id, sort_time, latitude, longitude, depth_km, magnitude, parent_id, gap_seconds, distance_km, parent_magnitude, parent_depth_km, log10_eta, is_strong,
  CASE WHEN is_strong THEN 'strong' ELSE 'weak' END AS link_type, cluster_id, CASE WHEN cluster_size = 1 THEN 'single' ELSE 'family' END AS cluster_type, cluster_size, event_role,
  cluster_size = 1 AS is_single, cluster_size > 1 AS is_family_member,
  CASE WHEN cluster_size > 1 THEN mainshock_id END AS mainshock_id, CASE WHEN cluster_size > 1 THEN mainshock_time END AS mainshock_time,
  CASE WHEN cluster_size > 1 THEN mainshock_magnitude END AS mainshock_magnitude,
  count(*) FILTER (event_role = 'foreshock') OVER (PARTITION BY cluster_id) AS foreshock_count, count(*) FILTER (event_role = 'aftershock') OVER (PARTITION BY cluster_id) AS aftershock_count
  FROM roles)"""


def sql(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"
