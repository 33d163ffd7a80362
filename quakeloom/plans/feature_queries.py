"""Queries on features, targets, samples and skew."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.operators import clusters, features, sampling, targets
from quakeloom.plans.cluster_queries import clustered, linked
from quakeloom.plans.oracle import CLUSTERED, KEPT, LINKED, P, km, r6, sql
from quakeloom.session import cut
from quakeloom.sources.derived import catalog

QUERIES, ORACLE_SQL = {}, {}


def _query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def kept(spark, sf_dir):
    return catalog(spark, sf_dir).where(F.col("magnitude") >= P.m_c)


def _rounded(df, *same):
    """All double columns but `same`, rounded."""
    return df.select(*(geo.rounded(F.col(c)).alias(c) if t == "double" and c not in same else F.col(c) for c, t in df.dtypes))


@_query(sql(LINKED, f"""SELECT event_id, {r6("log10_eta")} AS log10_eta, {r6("log10(gap_seconds / 31557600e0) - 0.5e0 * parent_magnitude")} AS log10_rescaled_time,
  {r6("1.6e0 * log10(distance_km) - 0.5e0 * parent_magnitude")} AS log10_rescaled_distance, is_strong::INT AS is_strong_link, (parent_id IS NOT NULL)::INT AS has_parent,
  {r6("gap_seconds / 86400e0")} AS parent_time_gap_days, {r6("distance_km")} AS parent_distance_km, parent_magnitude, parent_depth_km FROM linked"""))
def parent_features(spark, sf_dir):
    return _rounded(features.parent_features(linked(spark, sf_dir), P).drop("eta"), "parent_magnitude", "parent_depth_km")


_PAST = ", ".join(f"count(*) OVER (ORDER BY sort_time RANGE BETWEEN {d * 86400} PRECEDING AND CURRENT ROW) - count(*) OVER (ORDER BY sort_time RANGE BETWEEN CURRENT ROW AND CURRENT ROW) + row_number() OVER (PARTITION BY sort_time ORDER BY event_id) - 1 AS c{d}" for d in (1, 7, 30))
_FIVE = "count(*) OVER (ORDER BY sort_time RANGE BETWEEN 157788000 PRECEDING AND CURRENT ROW) - count(*) OVER (ORDER BY sort_time RANGE BETWEEN CURRENT ROW AND CURRENT ROW) + row_number() OVER (PARTITION BY sort_time ORDER BY event_id) - 1 AS c5y"
_RATIO = "CASE WHEN days < 30e0 THEN 1e0 ELSE c30 / greatest(c5y / (days / 30.4375e0), 1e-5) END"
_GLOBAL = f"""{KEPT}, g AS (SELECT event_id, {_PAST}, {_FIVE}, least(1826.25e0, greatest(1e0 / 24e0, (sort_time - min(sort_time) OVER ()) / 86400e0)) AS days FROM kept)"""


@_query(sql(_GLOBAL, "SELECT event_id, c1 AS events_past_1d, c7 AS events_past_7d, c30 AS events_past_30d FROM g"))
def global_activity(spark, sf_dir):
    return features.global_activity(kept(spark, sf_dir), P).drop("seis_traffic_ratio_30d")


@_query(sql(_GLOBAL, f"SELECT event_id, {r6(_RATIO)} AS seis_traffic_ratio_30d FROM g"))
def traffic_ratio(spark, sf_dir):
    return _rounded(features.global_activity(kept(spark, sf_dir), P).select("event_id", "seis_traffic_ratio_30d"))


_SERVE = ", ".join(f"(SELECT count(*) FROM kept h WHERE h.sort_time < q.sort_time AND h.sort_time >= q.sort_time - {s}) AS {n}" for n, s in (("c1", 86400), ("c7", 604800), ("c30", 2592000), ("c5y", 157788000), ("c_all", 10**12)))


@_query(sql(f"{KEPT}, g AS (SELECT event_id, {_SERVE}, least(1826.25e0, greatest(1e0 / 24e0, (sort_time - (SELECT min(sort_time) FROM kept)) / 86400e0)) AS days FROM catalog q WHERE event_id % 10 = 0)",
            f"SELECT event_id, c1 AS events_past_1d, c7 AS events_past_7d, c30 AS events_past_30d, {r6(f'CASE WHEN c_all = 0 THEN 1e0 ELSE {_RATIO} END')} AS seis_traffic_ratio_30d FROM g"))
def global_activity_serving(spark, sf_dir):
    """Counts before one event in ten, as a serving request sees them."""
    whole = catalog(spark, sf_dir)
    return _rounded(features.global_activity_serving(whole.where("event_id % 10 = 0"), whole, P))


@_query(sql(f"{KEPT}, g AS (SELECT event_id, {_SERVE}, least(1826.25e0, greatest(1e0 / 24e0, (sort_time - (SELECT min(sort_time) FROM kept)) / 86400e0)) AS days FROM catalog q)",
            f"SELECT event_id, c1 AS events_past_1d, c7 AS events_past_7d, c30 AS events_past_30d, {r6(f'CASE WHEN c_all = 0 THEN 1e0 ELSE {_RATIO} END')} AS seis_traffic_ratio_30d FROM g"))
def global_activity_serving_all(spark, sf_dir):
    """Counts before every event, as a serving request sees them."""
    whole = catalog(spark, sf_dir)
    return _rounded(features.global_activity_serving(whole, whole, P))


_NEAR = f"""{KEPT}, near AS MATERIALIZED (SELECT q.event_id, q.sort_time AS t, h.sort_time AS ht, h.event_id AS hid, h.magnitude AS m, {km('q', 'h')} AS km FROM kept q JOIN kept h
  ON h.sort_time >= q.sort_time - 2592000 AND (h.sort_time < q.sort_time OR (h.sort_time = q.sort_time AND h.event_id < q.event_id))
  AND abs(h.latitude - q.latitude) <= 100 / 111.32e0 AND abs(h.longitude - q.longitude) <= 100 / (111.32e0 * greatest(cos(radians(q.latitude)), 0.1e0))
  WHERE km <= 100)"""
_LOCAL = ", ".join(
    f"count(*) FILTER (km <= {r} AND ht >= t - {d * 86400}) AS local_events_{r}km_past_{d}d, coalesce(max(m) FILTER (km <= {r} AND ht >= t - {d * 86400}), 0) AS local_max_mag_{r}km_past_{d}d, "
    f"{r6(f'coalesce(log10(sum(pow(10e0, m * 1.5e0)) FILTER (km <= {r} AND ht >= t - {d * 86400})), 0)')} AS local_log10_energy_{r}km_past_{d}d"
    for r in P.radii_km for d in P.windows_days
)
_LOCAL_NAMES = features.local_names(P)


@_query(sql(f"{_NEAR}, g AS (SELECT event_id, {_LOCAL} FROM near GROUP BY event_id)", f"SELECT event_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _LOCAL_NAMES)} FROM kept LEFT JOIN g USING (event_id)"))
def local_activity(spark, sf_dir):
    k = cut(kept(spark, sf_dir))
    return _rounded(features.local_counts(k, k, P), *(n for n in _LOCAL_NAMES if "max_mag" in n))


@_query(sql(_NEAR, f"""SELECT event_id, {r6('km')} AS distance_km, m AS magnitude, {r6('(t - ht) / 86400e0')} AS age_days FROM kept
  LEFT JOIN (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, ht, hid) = 1) USING (event_id)"""))
def nearest_recent(spark, sf_dir):
    k = kept(spark, sf_dir)
    return _rounded(features.nearest_recent(k, k), "magnitude")


@_query(sql(f"""{KEPT}, g AS (SELECT q.event_id, count(*) AS n, avg(h.magnitude) AS mean FROM kept q JOIN kept h ON h.sort_time >= q.sort_time - 94672800
  AND (h.sort_time < q.sort_time OR (h.sort_time = q.sort_time AND h.event_id < q.event_id)) AND abs(h.latitude - q.latitude) <= 50 / 111.32e0
  AND abs(h.longitude - q.longitude) <= 50 / (111.32e0 * greatest(cos(radians(q.latitude)), 0.1e0)) WHERE {km('q', 'h')} <= 50 GROUP BY q.event_id)""",
            f"SELECT event_id, {r6('CASE WHEN n >= 5 AND mean > 1 THEN least(3e0, greatest(0.3e0, 0.4342944819e0 / (mean - 1))) ELSE 1e0 END')} AS local_b_value_50km_3y FROM kept LEFT JOIN g USING (event_id)"))
def local_b_value(spark, sf_dir):
    k = cut(kept(spark, sf_dir))
    return _rounded(features.local_b_value(k, k, P))


_TARGETS = f"""{CLUSTERED}, follow AS (SELECT e.event_id, min(d) AS nearest, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90, max(m) AS largest FROM (
  SELECT e.event_id, {km('e', 'a')} AS d, a.magnitude AS m FROM clustered e JOIN clustered a ON a.cluster_id = e.cluster_id AND a.event_role = 'aftershock'
  AND a.sort_time > e.sort_time AND a.sort_time <= e.sort_time + 86400) e GROUP BY e.event_id)"""


@_query(sql(_TARGETS, f"""SELECT event_id, CASE WHEN nearest IS NULL THEN 0 WHEN nearest <= 10 THEN 1 WHEN nearest <= 25 THEN 2 WHEN nearest <= 50 THEN 3 ELSE 4 END AS aftershock_spatial_zone_24h,
  (nearest IS NOT NULL)::INT AS aftershock_24h, coalesce(nearest <= 10, false)::INT AS aftershock_within_10km_24h, coalesce(nearest <= 25, false)::INT AS aftershock_within_25km_24h,
  coalesce(nearest <= 50, false)::INT AS aftershock_within_50km_24h, coalesce(nearest > 50, false)::INT AS aftershock_beyond_50km_24h, {r6('nearest')} AS nearest_aftershock_distance_km_24h,
  {r6('median')} AS median_aftershock_distance_km_24h, {r6('p90')} AS p90_aftershock_distance_km_24h, largest AS max_aftershock_mag_24h FROM clustered LEFT JOIN follow USING (event_id)""", recursive=True))
def forecast_targets(spark, sf_dir):
    return _rounded(targets.build(clustered(spark, sf_dir)), "max_aftershock_mag_24h")


@_query(sql(CLUSTERED, """SELECT e.event_id, count(*) FILTER (a.sort_time <= t + 172800) AS aftershocks_48h, count(*) FILTER (a.sort_time <= t + 259200) AS aftershocks_72h, count(a.sort_time) AS aftershocks_7d,
  coalesce(bool_or(a.magnitude > m), false)::INT AS larger_7d, coalesce(bool_or(a.magnitude >= 5), false)::INT AS m5_7d, min(a.sort_time) - any_value(t) AS seconds_to_next
  FROM (SELECT event_id, cluster_id, sort_time AS t, magnitude AS m FROM clustered) e LEFT JOIN clustered a ON a.cluster_id = e.cluster_id AND a.sort_time > t AND a.sort_time <= t + 604800 AND a.event_role = 'aftershock'
  GROUP BY e.event_id""", recursive=True))
def extended_targets(spark, sf_dir):
    """Counts over longer horizons, larger and strong aftershocks, time to the next one."""
    return targets.extended(clustered(spark, sf_dir))


@_query(sql(KEPT, "SELECT event_id, CASE WHEN y <= 2024 THEN 'train' WHEN y = 2025 THEN 'validate' ELSE 'test' END AS part FROM (SELECT event_id, year(to_timestamp(sort_time) AT TIME ZONE 'UTC') AS y FROM kept)"))
def chronological_split(spark, sf_dir):
    parts = sampling.chronological_split(kept(spark, sf_dir))
    out = None
    for name, part in parts.items():
        part = part.select("event_id", F.lit(name).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out


@_query(sql(f"{KEPT}, o AS (SELECT event_id, row_number() OVER (ORDER BY sort_time, event_id) - 1 AS i, count(*) OVER () AS n FROM kept)",
            "SELECT event_id FROM o WHERE i IN (SELECT floor(k * (n - 1) / 499e0)::BIGINT FROM range(500) r(k), (SELECT any_value(n) AS n FROM o))"))
def chronological_sample(spark, sf_dir):
    """500 events at even places in time order."""
    return sampling.chronological_sample(kept(spark, sf_dir), 500).select("event_id")


_SKEW_FEATURES = ["events_past_1d", "events_past_7d", "events_past_30d", "seis_traffic_ratio_30d"]
_SKEW_BATCH = "s AS (SELECT event_id, c1::DOUBLE AS events_past_1d, c7::DOUBLE AS events_past_7d, c30::DOUBLE AS events_past_30d, " + _RATIO + " AS seis_traffic_ratio_30d FROM {})"


@_query(sql(f"""{_GLOBAL}, {_SKEW_BATCH.format('g')},
h AS (SELECT event_id, {_SERVE}, least(1826.25e0, greatest(1e0 / 24e0, (sort_time - (SELECT min(sort_time) FROM kept)) / 86400e0)) AS days FROM kept q),
v AS (SELECT event_id, c1::DOUBLE AS events_past_1d, c7::DOUBLE AS events_past_7d, c30::DOUBLE AS events_past_30d, CASE WHEN c_all = 0 THEN 1e0 ELSE {_RATIO} END AS seis_traffic_ratio_30d FROM h),
l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, s.{f} AS a, v.{f} AS b FROM s JOIN v USING (event_id)" for f in _SKEW_FEATURES)})""",
            f"SELECT feature, count(*) AS rows, {r6('corr(a, b)')} AS correlation, {r6('quantile_cont(abs(a - b), 0.5)')} AS median_difference, {r6('avg(CASE WHEN abs(a - b) <= 1e-6 + 1e-3 * abs(b) THEN 100e0 ELSE 0e0 END)')} AS close_percent FROM l GROUP BY feature"))
def feature_skew(spark, sf_dir):
    """Batch against serving counts of the same events."""
    k = kept(spark, sf_dir)
    return features.skew(features.global_activity(k, P), features.global_activity_serving(k, k, P), _SKEW_FEATURES)


_EARLIER = "(h.sort_time < q.sort_time OR (h.sort_time = q.sort_time AND h.event_id < q.event_id))"
_NEAR_ALL = f"""near AS MATERIALIZED (SELECT q.event_id, q.sort_time AS t, h.sort_time AS ht, h.event_id AS hid, h.magnitude AS m, {km('q', 'h')} AS km, h.sort_time < q.sort_time AS strictly FROM kept q JOIN kept h
  ON h.sort_time >= q.sort_time - 94672800 AND {_EARLIER} AND abs(h.latitude - q.latitude) <= 100 / 111.32e0 AND abs(h.longitude - q.longitude) <= 100 / (111.32e0 * greatest(cos(radians(q.latitude)), 0.1e0))
  WHERE km <= 100)"""


def _form(n: str, near: str, counts: str) -> str:
    """The features of one form, not rounded, from its pairs and its counts."""
    inside = lambda r, d: f"km <= {r} AND ht >= t - {d * 86400}"
    local = ", ".join(f"count(*) FILTER ({inside(r, d)}) AS local_events_{r}km_past_{d}d, coalesce(max(m) FILTER ({inside(r, d)}), 0) AS local_max_mag_{r}km_past_{d}d, "
                      f"coalesce(log10(sum(pow(10e0, m * 1.5e0)) FILTER ({inside(r, d)})), 0) AS local_log10_energy_{r}km_past_{d}d" for r in P.radii_km for d in P.windows_days)  # fmt: skip
    least = "(SELECT min(magnitude) FROM kept)" if n == "serving" else "1"
    b = f"CASE WHEN bn >= 5 AND mean > {least} THEN least(3e0, greatest(0.3e0, 0.4342944819e0 / (mean - {least}))) ELSE 1e0 END"
    half = "abs(h.latitude - q.latitude) <= 50 / 111.32e0 AND abs(h.longitude - q.longitude) <= 50 / (111.32e0 * greatest(cos(radians(q.latitude)), 0.1e0))"
    return f"""{n}_local AS (SELECT event_id, {local} FROM ({near}) WHERE ht >= t - 2592000 GROUP BY event_id),
{n}_b AS (SELECT event_id, count(*) AS bn, avg(m) AS mean FROM ({near}) x JOIN (SELECT event_id AS qi, latitude AS qa, longitude AS qo FROM kept) q2 ON q2.qi = x.event_id JOIN (SELECT event_id AS hi, latitude AS ha, longitude AS ho FROM kept) h2 ON h2.hi = x.hid
  WHERE km <= 50 AND {half.replace('h.latitude', 'ha').replace('q.latitude', 'qa').replace('h.longitude', 'ho').replace('q.longitude', 'qo')} GROUP BY event_id),
{n}_recent AS (SELECT event_id, km AS nearest_recent_event_distance_km_past_30d, m AS nearest_recent_event_magnitude_past_30d, (t - ht) / 86400e0 AS nearest_recent_event_age_days_past_30d
  FROM ({near}) WHERE ht >= t - 2592000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, ht, hid) = 1),
{n} AS MATERIALIZED (SELECT k.event_id, magnitude, depth_km, latitude, longitude, pow(10e0, log10_eta) AS eta, log10_eta, log10(gap_seconds / 31557600e0) - 0.5e0 * parent_magnitude AS log10_rescaled_time,
  1.6e0 * log10(distance_km) - 0.5e0 * parent_magnitude AS log10_rescaled_distance, is_strong::INT AS is_strong_link, (parent_id IS NOT NULL)::INT AS has_parent, gap_seconds / 86400e0 AS parent_time_gap_days,
  distance_km AS parent_distance_km, parent_magnitude, parent_depth_km, year(moment) AS event_year, month(moment) AS event_month, dayofyear(moment) AS event_dayofyear, hour(moment) AS event_hour, isodow(moment) - 1 AS event_weekday,
  c1 AS events_past_1d, c7 AS events_past_7d, c30 AS events_past_30d, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _LOCAL_NAMES)},
  nearest_recent_event_distance_km_past_30d, nearest_recent_event_magnitude_past_30d, nearest_recent_event_age_days_past_30d,
  magnitude * exp(-depth_km / 50e0) AS rupture_depth_attenuation, {_RATIO if n == 'batch' else f'CASE WHEN c_all = 0 THEN 1e0 ELSE {_RATIO} END'} AS seis_traffic_ratio_30d, magnitude - 1.2e0 AS baths_law_limit, {b} AS local_b_value_50km_3y
  FROM (SELECT *, to_timestamp(sort_time) AT TIME ZONE 'UTC' AS moment FROM linked) k JOIN {counts} USING (event_id) LEFT JOIN {n}_local USING (event_id) LEFT JOIN {n}_b USING (event_id) LEFT JOIN {n}_recent USING (event_id))"""


_EACH = " UNION ALL ".join(f"SELECT '{f}' AS feature, a.{f}::DOUBLE AS a, b.{f}::DOUBLE AS b FROM batch a JOIN serving b USING (event_id)" for f in features.names())


@_query(sql(f"""{LINKED}, {_GLOBAL.removeprefix(KEPT + ', ')}, {_NEAR_ALL},
h AS (SELECT event_id, {_SERVE}, least(1826.25e0, greatest(1e0 / 24e0, (sort_time - (SELECT min(sort_time) FROM kept)) / 86400e0)) AS days FROM kept q),
{_form('batch', 'SELECT * FROM near', 'g')}, {_form('serving', 'SELECT * FROM near WHERE strictly', 'h')}, l AS ({_EACH})""",
            f"""SELECT feature, count(*) AS rows, {r6("CASE WHEN stddev_pop(a) FILTER (b IS NOT NULL) * stddev_pop(b) FILTER (a IS NOT NULL) > 0 THEN corr(a, b) END")} AS correlation, {r6('quantile_cont(abs(a - b), 0.5)')} AS median_difference,
  {r6('avg(CASE WHEN abs(a - b) <= 1e-6 + 1e-3 * abs(b) OR (a IS NULL AND b IS NULL) THEN 100e0 ELSE 0e0 END)')} AS close_percent FROM l GROUP BY feature"""))
def feature_skew_all(spark, sf_dir):
    """Batch against serving form of all 65 features of the same events."""
    k = kept(spark, sf_dir)
    return features.skew(cut(features.build(linked(spark, sf_dir), P)), cut(features.serve(k, k, P)), features.names(P))


@_query(sql(f"""{KEPT}, bins AS (SELECT floor((magnitude + 1e-9) / 0.1e0)::BIGINT AS i, count(*) AS n FROM kept GROUP BY 1), ends AS (SELECT min(i) AS a, max(i) - min(i) + 1 AS bins FROM bins),
spread AS (SELECT a, ends.bins AS l, ((i + k - a) % (2 * l) + 2 * l) % (2 * l) AS x, n * exp(-0.5e0 * (k / 1.2e0) * (k / 1.2e0)) AS w FROM bins, ends, range(-5, 6) r(k))""",
            f"SELECT a + least(x, 2 * l - 1 - x) AS bin, {r6('sum(w) / (SELECT sum(exp(-0.5e0 * (k / 1.2e0) * (k / 1.2e0))) FROM range(-5, 6) r(k))')} AS smoothed FROM spread GROUP BY 1"))
def smoothed_bins(spark, sf_dir):
    """Magnitude bins under a Gaussian kernel; counts beyond the ends are reflected."""
    return sampling.smoothed_histogram(kept(spark, sf_dir), "magnitude", 0.1)
