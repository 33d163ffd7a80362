"""Queries on links, clusters and their contracts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.operators import clusters, contract, mixture, neighbors
from quakeloom.params import YEAR_SECONDS
from quakeloom.plans.oracle import CLUSTERED, KEPT, LINKED, P, km, r6, sql
from quakeloom.session import reused, table
from quakeloom.sources.derived import catalog

QUERIES, ORACLE_SQL = {}, {}


def _query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their parents: several queries start from them, so they are found once a session."""
    return reused("linked", table(spark, sf_dir, "events"), lambda: neighbors.with_parents(catalog(spark, sf_dir), P))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.assign(linked(spark, sf_dir))


@_query(sql(LINKED, f"SELECT event_id, parent_id, gap_seconds, {r6('distance_km')} AS distance_km, {r6('log10_eta')} AS log10_eta, is_strong FROM linked"))
def nearest_parent(spark, sf_dir):
    l = linked(spark, sf_dir)  # noqa: E741
    return l.select("event_id", "parent_id", "gap_seconds", geo.rounded(F.col("distance_km")).alias("distance_km"), geo.rounded(F.col("log10_eta")).alias("log10_eta"), "is_strong")


@_query(sql(LINKED, f"""SELECT event_id, {r6(f"log10(gap_seconds / 31557600e0) - {P.q * P.b} * parent_magnitude")} AS log10_t, {r6(f"{P.d_f}e0 * log10(distance_km) - {(1 - P.q) * P.b} * parent_magnitude")} AS log10_r
  FROM linked WHERE parent_id IS NOT NULL"""))
def rescaled_tr(spark, sf_dir):
    l = linked(spark, sf_dir).where("parent_id IS NOT NULL")  # noqa: E741
    t = geo.log10_rescaled_time(F.col("gap_seconds"), F.col("parent_magnitude"), P)
    return l.select("event_id", geo.rounded(t).alias("log10_t"), geo.rounded(geo.log10_rescaled_distance(F.col("distance_km"), F.col("parent_magnitude"), P)).alias("log10_r"))


@_query(sql(LINKED, "SELECT floor(i * 0.1e0 * 1e3 + 0.5e0) / 1e3 AS bin_lower, floor((i + 1) * 0.1e0 * 1e3 + 0.5e0) / 1e3 AS bin_upper, count(*) AS event_count FROM (SELECT floor((log10_eta + 1e-9) / 0.1e0)::BIGINT AS i FROM linked WHERE log10_eta IS NOT NULL) GROUP BY i"))
def eta_histogram(spark, sf_dir):
    return neighbors.eta_histogram(linked(spark, sf_dir))


_THRESHOLDS = [-6.0, -5.5, P.log10_eta0, -5.0, -4.5]


@_query(sql(f"{LINKED}, t(threshold) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in _THRESHOLDS)})",
            f"""SELECT threshold, s AS strong_links, n - s AS weak_links, {r6('s * 100e0 / n')} AS strong_percent, {r6('(n - s) * 100e0 / n')} AS weak_percent
  FROM (SELECT threshold, (SELECT count(*) FROM linked WHERE log10_eta < threshold) AS s, (SELECT count(*) FROM linked) AS n FROM t)"""))
def eta_threshold_links(spark, sf_dir):
    return neighbors.threshold_links(linked(spark, sf_dir), _THRESHOLDS)


@_query(sql(CLUSTERED, "SELECT event_id, root FROM rooted", recursive=True))
def cluster_roots(spark, sf_dir):
    return clusters.cluster_roots(linked(spark, sf_dir))


_LABELS = ", ".join(clusters.LABELS)


@_query(sql(CLUSTERED, f"SELECT event_id, parent_id, is_strong, {_LABELS} FROM clustered", recursive=True))
def clustered_events(spark, sf_dir):
    return clustered(spark, sf_dir).select("event_id", "parent_id", "is_strong", *clusters.LABELS)


_FAMILIES = f"""SELECT cluster_id, count(*) AS members, max(foreshock_count) AS foreshocks, max(aftershock_count) AS aftershocks, max(mainshock_id) AS mainshock_id,
  max(mainshock_magnitude) AS mainshock_magnitude, {r6('(max(sort_time) - min(sort_time)) / 86400e0')} AS duration_days FROM clustered WHERE is_family_member GROUP BY cluster_id"""


@_query(sql(CLUSTERED, _FAMILIES, recursive=True))
def family_summary(spark, sf_dir):
    return clusters.family_summary(clustered(spark, sf_dir))


@_query(sql(CLUSTERED, f"{_FAMILIES} ORDER BY members DESC, cluster_id LIMIT 10", recursive=True))
def largest_families(spark, sf_dir):
    return clusters.largest_families(clustered(spark, sf_dir))


@_query(sql(CLUSTERED, "SELECT event_role, link_type, cluster_type, count(*) AS events FROM clustered GROUP BY ALL", recursive=True))
def role_counts(spark, sf_dir):
    return clusters.role_counts(clustered(spark, sf_dir))


_MIX = ", ".join(f"{r6(f'''count(*) FILTER (event_role = '{r}') * 100e0 / count(*)''')} AS {r}_percent" for r in ("single", "mainshock", "foreshock", "aftershock"))


@_query(sql(CLUSTERED, f"SELECT floor(magnitude)::BIGINT AS magnitude_band, count(*) AS events, {_MIX} FROM clustered GROUP BY 1", recursive=True))
def role_mix_by_magnitude(spark, sf_dir):
    return clusters.role_mix(clustered(spark, sf_dir))


@_query(sql(CLUSTERED, f"SELECT event_id, cluster_id, magnitude, event_role FROM clustered WHERE is_family_member AND mainshock_magnitude >= {P.m_c + 2.0} AND magnitude >= mainshock_magnitude - 2e0", recursive=True))
def delta_members(spark, sf_dir):
    return clusters.delta_members(clustered(spark, sf_dir), P.m_c).select("event_id", "cluster_id", "magnitude", "event_role")


def _windows(source: str) -> str:
    share = lambda c: r6(f"{c} * 100e0 / nullif(valid, 0)")
    return f"""SELECT *, events - valid AS invalid, {share('within_1d')} AS within_1d_percent, {share('from_1d_to_7d')} AS from_1d_to_7d_percent, {share('after_7d')} AS after_7d_percent FROM (
  SELECT count(*) AS events, count(*) FILTER (d >= 0) AS valid, count(*) FILTER (d >= 0 AND d <= 1) AS within_1d, count(*) FILTER (d > 1 AND d <= 7) AS from_1d_to_7d,
    count(*) FILTER (d > 7) AS after_7d FROM {source})"""


_DELAYS = f"{CLUSTERED}, delays AS (SELECT *, (sort_time - mainshock_time) / 86400e0 AS d FROM clustered WHERE event_role = 'aftershock')"


@_query(sql(_DELAYS, _windows("delays"), recursive=True))
def aftershock_windows(spark, sf_dir):
    return clusters.window_summary(clusters.with_delay(clustered(spark, sf_dir)))


@_query(sql(f"{_DELAYS}, best AS (SELECT * FROM delays QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY magnitude DESC, d, event_id) = 1)", _windows("best"), recursive=True))
def strongest_aftershock_windows(spark, sf_dir):
    return clusters.window_summary(clusters.strongest_aftershocks(clustered(spark, sf_dir)))


def damaged(df: DataFrame) -> DataFrame:
    """A clustered table with some labels spoiled by fixed residues."""
    every = lambda m, r: F.col("event_id") % m == r
    return df.withColumns({
        "link_type": F.when(every(97, 3), "odd").otherwise(F.col("link_type")),
        "is_single": F.when(every(89, 5), ~F.col("is_single")).otherwise(F.col("is_single")),
        "cluster_size": F.when(every(83, 7), F.col("cluster_size") + 1).otherwise(F.col("cluster_size")),
        "mainshock_magnitude": F.when(every(79, 2), F.col("mainshock_magnitude") + 0.5).otherwise(F.col("mainshock_magnitude")),
        "aftershock_count": F.when(every(73, 1), F.col("aftershock_count") + 1).otherwise(F.col("aftershock_count")),
    })


_DAMAGED = f"""{CLUSTERED},
bad AS MATERIALIZED (SELECT * REPLACE (CASE WHEN event_id % 97 = 3 THEN 'odd' ELSE link_type END AS link_type, CASE WHEN event_id % 89 = 5 THEN NOT is_single ELSE is_single END AS is_single,
  CASE WHEN event_id % 83 = 7 THEN cluster_size + 1 ELSE cluster_size END AS cluster_size, CASE WHEN event_id % 79 = 2 THEN mainshock_magnitude + 0.5e0 ELSE mainshock_magnitude END AS mainshock_magnitude,
  CASE WHEN event_id % 73 = 1 THEN aftershock_count + 1 ELSE aftershock_count END AS aftershock_count) FROM clustered)"""
_ROW_RULES = {
    "link_type is strong or weak": "link_type NOT IN ('strong', 'weak')",
    "strong links are flagged": "(link_type = 'strong') IS DISTINCT FROM is_strong",
    "is_single follows cluster_type": "is_single IS DISTINCT FROM (cluster_type = 'single')",
    "is_family_member is the opposite": "is_family_member = is_single",
    "singles have one member": "cluster_type = 'single' AND cluster_size <> 1",
    "singles count nobody": "cluster_type = 'single' AND (foreshock_count <> 0 OR aftershock_count <> 0)",
}
_GROUP_RULES = {
    "cluster_size is the number of members": "least <> n OR most <> n",
    "mainshock_magnitude is the mainshock's": "n > 1 AND abs(magnitude - main_magnitude) > 1e-9",
    "aftershock_count is the number of aftershocks": "after <> after_told",
}


@_query(sql(_DAMAGED, " UNION ALL ".join(f"SELECT event_id, '{rule}' AS rule FROM bad WHERE {bad}" for rule, bad in _ROW_RULES.items()), recursive=True))
def contract_violations_rows(spark, sf_dir):
    return contract.row_violations(damaged(clustered(spark, sf_dir)))


@_query(sql(f"""{_DAMAGED}, g AS (SELECT cluster_id, count(*) AS n, min(cluster_size) AS least, max(cluster_size) AS most, max(mainshock_magnitude) AS magnitude,
  max(magnitude) FILTER (event_role = 'mainshock') AS main_magnitude, count(*) FILTER (event_role = 'aftershock') AS after, max(aftershock_count) AS after_told FROM bad GROUP BY cluster_id)""",
            " UNION ALL ".join("SELECT cluster_id, '{}' AS rule FROM g WHERE {}".format(rule.replace("'", "''"), bad) for rule, bad in _GROUP_RULES.items()), recursive=True))
def contract_violations_groups(spark, sf_dir):
    return contract.group_violations(damaged(clustered(spark, sf_dir)))


@_query(sql(CLUSTERED, "SELECT event_id AS id, 'event' AS \"of\", '' AS rule FROM clustered WHERE false", recursive=True))
def contract_holds(spark, sf_dir):
    """No violation on undamaged clusters."""
    return contract.violations(clustered(spark, sf_dir)).select("id", "of", "rule")


@_query(sql(f"{LINKED}, q AS (SELECT * FROM catalog WHERE event_id % 50 = 0)",
            f"""SELECT event_id, arg_min(parent_id, lt + {P.d_f}e0 * log10(d) - {P.b} * pm) AS parent_id FROM (
  SELECT q.event_id, i.event_id AS parent_id, log10((q.sort_time - i.sort_time) / 31557600e0) AS lt, {km('q', 'i')} AS d, i.magnitude AS pm FROM q JOIN kept i ON i.sort_time < q.sort_time)
  WHERE d > 0 GROUP BY event_id"""))
def serving_parents(spark, sf_dir):
    """Parents of one event in fifty, found as a serving request finds them."""
    whole = catalog(spark, sf_dir)
    return neighbors.parents_of_queries(whole.where("event_id % 50 = 0"), whole, P)


@_query(sql(LINKED, f"""SELECT event_id, arg_min(parent_id, lt + {P.d_f}e0 * log10(d) - {P.b} * pm) AS parent_id FROM (
  SELECT q.event_id, i.event_id AS parent_id, log10((q.sort_time - i.sort_time) / 31557600e0) AS lt, {km('q', 'i')} AS d, i.magnitude AS pm FROM catalog q JOIN kept i ON i.sort_time < q.sort_time)
  WHERE d > 0 GROUP BY event_id"""))
def serving_parents_all(spark, sf_dir):
    """Parents of all events, found as a serving request finds them."""
    whole = catalog(spark, sf_dir)
    return neighbors.parents_of_queries(whole, whole, P)


_CUTOFFS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]
_BY_CUTOFF = f"""{KEPT}, pairs AS (SELECT j.event_id, j.magnitude AS jm, i.event_id AS parent_id, i.magnitude AS pm,
  log10((j.sort_time - i.sort_time) / {YEAR_SECONDS!r}::DOUBLE) + {P.d_f!r}::DOUBLE * log10(nullif({km("j", "i")}, 0)) - {P.b!r}::DOUBLE * i.magnitude AS eta
  FROM kept j JOIN kept i ON i.sort_time < j.sort_time),
best AS (SELECT event_id, {", ".join(f"arg_min({{'id': parent_id, 'eta': eta}}, eta) FILTER (eta IS NOT NULL AND pm >= {m}::DOUBLE) AS b{i}" for i, m in enumerate(_CUTOFFS))} FROM pairs GROUP BY event_id),
steps AS ({" UNION ALL ".join(f"SELECT {m}::DOUBLE AS m_c, k.event_id, b{i}.id AS parent_id, b{i}.eta AS eta FROM kept k LEFT JOIN best USING (event_id) WHERE k.magnitude >= {m}::DOUBLE" for i, m in enumerate(_CUTOFFS))})"""


@_query(sql(_BY_CUTOFF, f"SELECT m_c, event_id, parent_id, {r6('eta')} AS log10_eta FROM steps"))
def parents_by_cutoff(spark, sf_dir):
    """Parents among the events of magnitude m_c or more, for seven m_c from one search."""
    found = neighbors.parents_by_cutoff(catalog(spark, sf_dir), _CUTOFFS, P)
    return found.withColumn("log10_eta", geo.rounded(F.col("log10_eta")))


@_query(sql(_BY_CUTOFF, f"""SELECT m_c, count(*) AS events, count(parent_id) AS linked, count(*) FILTER (eta < {P.log10_eta0!r}::DOUBLE) AS strong_links,
  floor((eta + 1e-9) / 1e0)::BIGINT AS eta_bin FROM steps GROUP BY m_c, eta_bin"""))
def links_by_cutoff(spark, sf_dir):
    """Links of each m_c by whole powers of ten of eta."""
    found = neighbors.with_parents_by_cutoff(catalog(spark, sf_dir), _CUTOFFS, P)
    return found.groupBy("m_c", geo.bin_index(F.col("log10_eta"), 1.0).alias("eta_bin")).agg(F.count("*").alias("events"), F.count("parent_id").alias("linked"), F.count_if("is_strong").alias("strong_links"))


_EM_ROUNDS, _EM_WIDTH, _EM_LEAST = 25, 0.01, 1e-4
_DENSITY = "(ln({w}) - 0.5e0 * ln({v} * {two_pi!r}::DOUBLE) - (x - {m}) * (x - {m}) / ({v} * 2e0))"
_D1, _D2 = (_DENSITY.format(w=w, m=m, v=v, two_pi=2 * math.pi) for w, m, v in (("w1", "m1", "v1"), ("(1e0 - w1)", "m2", "v2")))
_EM = f"""{LINKED},
bins AS MATERIALIZED (SELECT i * {_EM_WIDTH}::DOUBLE AS x, n FROM (SELECT floor(log10_eta / {_EM_WIDTH}::DOUBLE + 0.5e0) AS i, count(*)::DOUBLE AS n FROM linked WHERE log10_eta IS NOT NULL GROUP BY i)),
upto AS (SELECT *, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total FROM bins),
whole AS MATERIALIZED (SELECT max(total) AS nn, sum(x * n) AS sx, sum(x * x * n) AS sxx, min(x) FILTER (upto >= total * 0.25e0) AS q1, min(x) FILTER (upto >= total * 0.75e0) AS q3 FROM upto),
em(i, w1, m1, v1, m2, v2) AS (
  SELECT 0, 0.5e0, q1, sxx / nn - sx / nn * sx / nn, q3, sxx / nn - sx / nn * sx / nn FROM whole WHERE q1 < q3
  UNION ALL SELECT i + 1, r / nn, rx / r, greatest(rxx / r - rx / r * rx / r, {_EM_LEAST}::DOUBLE), (sx - rx) / (nn - r), greatest((sxx - rxx) / (nn - r) - (sx - rx) / (nn - r) * (sx - rx) / (nn - r), {_EM_LEAST}::DOUBLE)
    FROM (SELECT i, sum(p) AS r, sum(p * x) AS rx, sum(p * x * x) AS rxx FROM (SELECT i, x, n / (exp({_D2} - {_D1}) + 1e0) AS p FROM em, bins WHERE i < {_EM_ROUNDS}) GROUP BY i), whole),
s AS (SELECT * FROM em WHERE i = {_EM_ROUNDS}),
ll AS (SELECT sum(n * (greatest({_D1}, {_D2}) + ln(1e0 + exp(-abs({_D1} - {_D2}))))) AS ll FROM s, bins),
q AS (SELECT *, 0.5e0 / v1 - 0.5e0 / v2 AS a, m2 / v2 - m1 / v1 AS b, m1 * m1 / (v1 * 2e0) - m2 * m2 / (v2 * 2e0) - ln(w1 / (1e0 - w1)) - 0.5e0 * ln(v2 / v1) AS c, (m1 + m2) / 2e0 AS mid FROM s),
roots AS (SELECT *, (-b - sqrt(greatest(b * b - a * c * 4e0, 0e0))) / (a * 2e0) AS lo, (-b + sqrt(greatest(b * b - a * c * 4e0, 0e0))) / (a * 2e0) AS hi FROM q),
cross_at AS (SELECT *, CASE WHEN abs(a) < 1e-12 THEN -c / b WHEN b * b - a * c * 4e0 < 0 THEN mid WHEN lo BETWEEN least(m1, m2) AND greatest(m1, m2) THEN lo WHEN hi BETWEEN least(m1, m2) AND greatest(m1, m2) THEN hi
  WHEN abs(lo - mid) <= abs(hi - mid) THEN lo ELSE hi END AS eta0 FROM roots),
parts AS (SELECT 0 AS component, w1 AS weight, m1 AS mean, sqrt(v1) AS sigma, eta0 FROM cross_at UNION ALL SELECT 1, 1e0 - w1, m2, sqrt(v2), eta0 FROM cross_at)"""


@_query(sql(_EM, f"""SELECT component, {r6('weight')} AS weight, {r6('mean')} AS mean, {r6('sigma')} AS sigma, {r6('eta0')} AS log10_eta0,
  {r6('10e0 - ll * 2e0', 3)} AS aic, {r6('ln(nn) * 5e0 - ll * 2e0', 3)} AS bic FROM parts, ll, whole""", recursive=True))
def gmm_eta0_em(spark, sf_dir):
    """The two components and the threshold between them by a fixed number of rounds from a fixed start."""
    found = mixture.expectation_maximisation(linked(spark, sf_dir), _EM_ROUNDS, _EM_WIDTH, _EM_LEAST)
    digits = {"aic": 3, "bic": 3}
    return found.select("component", *(geo.rounded(F.col(c), digits.get(c, 6)).alias(c) for c in ("weight", "mean", "sigma", "log10_eta0", "aic", "bic")))
