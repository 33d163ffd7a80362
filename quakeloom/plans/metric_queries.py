"""Queries on metrics and the choice of families, over scores that are derived from the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.operators import backtests, isotonic, metrics, skew
from quakeloom.plans.oracle import KEPT, P, r6, sql
from quakeloom.sources.derived import catalog

QUERIES, ORACLE_SQL = {}, {}
FAMILIES, TARGETS = ("forest", "gbt", "linear", "logit"), ("aftershock_24h", "aftershock_within_10km_24h")
KEYS = ["family", "target"]


def _query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def scores(spark, sf_dir):
    """event_id, family, target, label, probability, actual, predicted of every event, by fixed residues."""
    events = catalog(spark, sf_dir).where(F.col("magnitude") >= P.m_c)
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(i).alias("fi"), F.lit(t).alias("target"), F.lit(j).alias("ti")) for i, f in enumerate(FAMILIES) for j, t in enumerate(TARGETS)))).alias("x")
    return events.select("event_id", "magnitude", pairs).select("event_id", "magnitude", "x.*").selectExpr(
        "event_id", "family", "target", "cast((event_id * 7 + ti * 3) % 10 < 3 as int) AS label",
        "(event_id * (37 + fi * 12)) % 1000 / 1000D * 0.7D + cast((event_id * 7 + ti * 3) % 10 < 3 as int) * 0.3D AS probability",
        "if(event_id % 3 = 0, NULL, magnitude) AS actual", "magnitude + ((event_id * (41 + fi * 6)) % 100 - 50) / 100D AS predicted",
    )


_NAMES = ", ".join(f"('{f}', {i}, '{t}', {j})" for i, f in enumerate(FAMILIES) for j, t in enumerate(TARGETS))
SCORES = f"""{KEPT}, names(family, fi, target, ti) AS (VALUES {_NAMES}),
s AS MATERIALIZED (SELECT family, target, ((event_id * 7 + ti * 3) % 10 < 3)::INT AS label,
  (event_id * (37 + fi * 12)) % 1000 / 1000e0 * 0.7e0 + ((event_id * 7 + ti * 3) % 10 < 3)::INT * 0.3e0 AS probability,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE magnitude END AS actual, magnitude + ((event_id * (41 + fi * 6)) % 100 - 50) / 100e0 AS predicted FROM kept, names)"""

_CLASS = f"""SELECT family, target, count(*) AS n, {r6('avg((probability - label) * (probability - label))')} AS brier,
  {r6('-avg(label * ln(least(greatest(probability, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(probability, 1e-7), 1 - 1e-7)))')} AS log_loss,
  {r6('coalesce(count(*) FILTER (probability >= 0.5e0 AND label = 1) / nullif(count(*) FILTER (probability >= 0.5e0), 0), 0)')} AS precision,
  {r6('coalesce(count(*) FILTER (probability >= 0.5e0 AND label = 1) / nullif(sum(label), 0), 0)')} AS recall, {r6('avg(label)')} AS positive_rate, {r6('avg(probability)')} AS mean_probability
  FROM s GROUP BY family, target"""
_AUC = f"""SELECT family, target, {r6('(sum(r) FILTER (label = 1) - any_value(np) * (any_value(np) + 1) / 2e0) / (any_value(np) * any_value(nn))')} AS roc_auc FROM (
  SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY family, target, probability) - 1) / 2e0 AS r, sum(label) OVER (PARTITION BY family, target)::DOUBLE AS np,
    sum(1 - label) OVER (PARTITION BY family, target)::DOUBLE AS nn FROM s WINDOW w AS (PARTITION BY family, target ORDER BY probability)) GROUP BY family, target"""
_AP = f"""SELECT family, target, {r6('sum(pos * tp / (tp + fp)) / sum(pos)')} AS average_precision FROM (
  SELECT family, target, probability, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT family, target, probability, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL)
  WINDOW w AS (PARTITION BY family, target ORDER BY probability DESC ROWS UNBOUNDED PRECEDING)) GROUP BY family, target"""
_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in metrics.EDGES) + "]"
_BINS = f"""SELECT family, target, len(list_filter({_EDGES}, lambda e: probability >= e))::INT AS bin, count(*) AS n, avg(probability) AS mp, avg(label) AS rate FROM s GROUP BY ALL"""
_ECE = f"SELECT family, target, {r6('sum(n * abs(mp - rate)) / sum(n)')} AS ece FROM ({_BINS}) GROUP BY family, target"
_REG = f"""SELECT family, target, count(actual) AS n, {r6('avg(abs(actual - predicted))')} AS mae, {r6('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse,
  {r6('1 - sum((actual - predicted) * (actual - predicted)) / nullif(sum(actual * actual) - sum(actual) * sum(actual) / count(actual), 0)')} AS r2, {r6('avg(actual)')} AS mean_actual,
  {r6('avg(predicted) FILTER (actual IS NOT NULL)')} AS mean_predicted FROM s GROUP BY family, target"""


@_query(sql(SCORES, _CLASS))
def classification_metrics(spark, sf_dir):
    return metrics.classification(scores(spark, sf_dir), KEYS)


@_query(sql(SCORES, _AUC))
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scores(spark, sf_dir), KEYS)


@_query(sql(SCORES, _AP))
def average_precision(spark, sf_dir):
    return metrics.average_precision(scores(spark, sf_dir), KEYS)


@_query(sql(SCORES, f"SELECT family, target, bin, n, {r6('mp')} AS mean_probability, {r6('rate')} AS observed_rate FROM ({_BINS})"))
def ece_bins(spark, sf_dir):
    found = metrics.reliability(scores(spark, sf_dir), KEYS)
    return found.withColumns({c: geo.rounded(F.col(c)) for c in ("mean_probability", "observed_rate")})


@_query(sql(SCORES, _ECE))
def expected_calibration_error(spark, sf_dir):
    return metrics.expected_calibration_error(scores(spark, sf_dir), KEYS)


@_query(sql(SCORES, "SELECT family, target, least(floor(probability * 20), 19)::INT AS bin, count(*) AS n FROM s GROUP BY ALL"))
def probability_histogram(spark, sf_dir):
    return metrics.probability_histogram(scores(spark, sf_dir), KEYS)


@_query(sql(SCORES, _REG))
def regression_metrics(spark, sf_dir):
    return metrics.regression(scores(spark, sf_dir), KEYS)


def long_metrics(spark, sf_dir):
    """All classification metrics as family, target, metric, value."""
    s = scores(spark, sf_dir)
    wide = metrics.classification(s, KEYS).join(metrics.roc_auc(s, KEYS), KEYS).join(metrics.average_precision(s, KEYS), KEYS).join(metrics.expected_calibration_error(s, KEYS), KEYS)
    return metrics.long_form(wide, KEYS, list(metrics.CLASS_WEIGHTS))


_LONG = f"""{SCORES}, a AS ({_CLASS}), b AS ({_AUC}), c AS ({_AP}), d AS ({_ECE}), w AS (SELECT * FROM a JOIN b USING (family, target) JOIN c USING (family, target) JOIN d USING (family, target)),
m AS (SELECT family, target, 'brier' AS metric, brier AS value, 0.5e0 AS weight, true AS less FROM w UNION ALL SELECT family, target, 'ece', ece, 0.25e0, true FROM w
  UNION ALL SELECT family, target, 'average_precision', average_precision, 0.15e0, false FROM w UNION ALL SELECT family, target, 'roc_auc', roc_auc, 0.1e0, false FROM w),
sc AS (SELECT target, family, {r6('sum(weight * part)')} AS score FROM (SELECT *, CASE WHEN value IS NULL THEN 0 WHEN hi = lo THEN 1 WHEN less THEN 1 - (value - lo) / (hi - lo) ELSE (value - lo) / (hi - lo) END AS part
  FROM (SELECT *, min(value) OVER (PARTITION BY target, metric) AS lo, max(value) OVER (PARTITION BY target, metric) AS hi FROM m)) GROUP BY target, family)"""


@_query(sql(_LONG, "SELECT target, family, score FROM sc"))
def weighted_pick(spark, sf_dir):
    return metrics.weighted_scores(long_metrics(spark, sf_dir), metrics.CLASS_WEIGHTS)


@_query(sql(_LONG, f"SELECT family, {r6('sum(score)')} AS score FROM sc GROUP BY family ORDER BY score DESC, family LIMIT 1"))
def family_pick(spark, sf_dir):
    return metrics.pick_overall(metrics.weighted_scores(long_metrics(spark, sf_dir), metrics.CLASS_WEIGHTS))


@_query(sql(f"{_LONG}, old AS (SELECT family, target, metric, value FROM m WHERE family <> 'logit'), new AS (SELECT family, target, metric, value * 1.1e0 AS value FROM m WHERE family <> 'linear')",
            f"SELECT family, target, metric, o.value AS before, {r6('n.value')} AS after, {r6('n.value - o.value')} AS delta, CASE WHEN metric IN ('brier', 'ece') THEN n.value - o.value < 0 ELSE n.value - o.value > 0 END AS better FROM old o FULL JOIN new n USING (family, target, metric)"))
def metric_deltas(spark, sf_dir):
    """Changes between two tables, of which each lacks a family."""
    m = long_metrics(spark, sf_dir)
    found = metrics.deltas(m.where("family <> 'logit'"), m.where("family <> 'linear'").withColumn("value", F.col("value") * 1.1))
    return found.withColumn("after", geo.rounded(F.col("after")))


_YEARLY = _LONG.replace("FROM kept, names)", "FROM (SELECT *, year(to_timestamp(sort_time) AT TIME ZONE 'UTC')::INT AS year FROM kept), names)")
for _old, _new in (("family, target", "year, family, target"), ("target, family", "year, target, family"), ("BY target, metric", "BY year, target, metric"), ("names(year, family", "names(family")):
    _YEARLY = _YEARLY.replace(_old, _new)


def yearly_scores(spark, sf_dir):
    """`scores` with the year of each event."""
    events = catalog(spark, sf_dir).select("event_id", F.year(F.timestamp_seconds("sort_time")).alias("year"))
    return scores(spark, sf_dir).join(events, "event_id")


@_query(sql(f"""{_YEARLY}, total AS (SELECT year, family, {r6('sum(score)')} AS total FROM sc GROUP BY year, family),
chosen AS (SELECT year, family FROM total QUALIFY row_number() OVER (PARTITION BY year ORDER BY total DESC, family) = 1),
won AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY year, target ORDER BY score DESC, family) = 1)""",
            """SELECT sc.year, sc.target, sc.family AS pick, sc.score AS pick_score, won.family AS raw_winner, won.score AS raw_winner_score
  FROM sc JOIN chosen ON chosen.year = sc.year AND chosen.family = sc.family JOIN won ON won.year = sc.year AND won.target = sc.target"""))
def year_picks(spark, sf_dir):
    """The picked family and the best one of each target, per year."""
    return backtests.picks(backtests.measured(yearly_scores(spark, sf_dir)))


@_query(sql(f"""{SCORES}, v AS MATERIALIZED (SELECT family, target, probability, count(*) AS n, sum(label) AS pos, row_number() OVER (PARTITION BY family, target ORDER BY probability) AS k FROM s GROUP BY family, target, probability),
c AS MATERIALIZED (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM v WINDOW w AS (PARTITION BY family, target ORDER BY k ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT i.family, i.target, i.k AS i, j.k AS j, (j.cp - i.cp + i.pos) / (j.cn - i.cn + i.n)::DOUBLE AS rate FROM c i JOIN c j ON j.family = i.family AND j.target = i.target AND j.k >= i.k),
least AS (SELECT family, target, j, min(rate) OVER (PARTITION BY family, target, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS rate FROM rates),
best AS (SELECT family, target, j AS k, max(rate) AS rate FROM least GROUP BY ALL)""",
            f"SELECT family, target, {r6('probability')} AS probability, n, {r6('rate')} AS calibrated FROM v JOIN best USING (family, target, k)"))
def isotonic_calibration(spark, sf_dir):
    """The calibrated probability of every distinct score; the SQL has the least of all means from there on, and the largest of these so far."""
    s = scores(spark, sf_dir)
    values = s.groupBy(*KEYS, "probability").agg(F.count("*").alias("n"))
    found = isotonic.calibrate(values, isotonic.fit(s, KEYS), KEYS)
    return found.select(*KEYS, geo.rounded(F.col("probability")).alias("probability"), "n", geo.rounded(F.col("calibrated")).alias("calibrated"))


_SKEWED = f"""{SCORES.replace("AS MATERIALIZED (SELECT family,", "AS MATERIALIZED (SELECT event_id, family,")}, p AS (SELECT event_id, target, a.label, a.probability AS batch, b.probability AS serving
  FROM s a JOIN s b USING (event_id, target) WHERE a.family = 'forest' AND b.family = 'gbt'),
u AS (SELECT target, 'batch' AS form, label, batch AS probability FROM p UNION ALL SELECT target, 'serving', label, serving FROM p),
e AS (SELECT target, form, {r6('sum(n * abs(mp - rate)) / sum(n)')} AS ece FROM (SELECT target, form, len(list_filter({_EDGES}, lambda e: probability >= e)) AS bin, count(*) AS n, avg(probability) AS mp, avg(label) AS rate FROM u GROUP BY ALL) GROUP BY ALL),
m AS (SELECT target, form, {r6('avg((probability - label) * (probability - label))')} AS brier, {r6('avg(probability)')} AS mean FROM u GROUP BY ALL),
w AS (SELECT target, {', '.join(f"any_value({c}) FILTER (form = '{f}') AS {c}_{f}" for f in ('batch', 'serving') for c in ('brier', 'ece', 'mean'))} FROM m JOIN e USING (target, form) GROUP BY target)"""


@_query(sql(_SKEWED, f"""SELECT * FROM w JOIN (SELECT target, count(*) AS rows, {r6('avg(abs(batch - serving))')} AS mean_change, {r6('quantile_cont(abs(batch - serving), 0.5)')} AS median_change,
  {r6('quantile_cont(abs(batch - serving), 0.9)')} AS p90_change, {r6('corr(batch, serving)')} AS correlation FROM p GROUP BY target) USING (target)"""))
def skew_effect(spark, sf_dir):
    """The effect of two forms on the same events' scores; here the scores of two families stand for the two forms."""
    s = scores(spark, sf_dir)
    form = lambda family, name: s.where(f"family = '{family}'").select("event_id", "target", "label", F.col("probability").alias(name))
    return skew.effect(form("forest", "batch").join(form("gbt", "serving").drop("label"), ["event_id", "target"]), ["target"])


_ZONES = "p1 + p2 + p3 + p4 AS p_any, p1 AS p_within_10km, p1 + p2 AS p_within_25km, p1 + p2 + p3 AS p_within_50km, p4 AS p_beyond_50km"
_PARTS = ", ".join(f"(event_id * {k}) % 50 / 250e0 AS p{i}" for i, k in enumerate((3, 7, 11, 13, 17)))


@_query(sql(f"{KEPT}, p AS (SELECT event_id, {_PARTS} FROM kept), c AS (SELECT event_id, {_ZONES} FROM p)",
            f"""SELECT event_id, {', '.join(f"{r6(x)} AS {n}" for x, n in (('p_any', 'p_any'), ('p_within_10km', 'p_within_10km'), ('p_within_25km', 'p_within_25km'), ('p_within_50km', 'p_within_50km'), ('p_beyond_50km', 'p_beyond_50km'),
  ('p_within_10km', 'z_10'), ('p_within_25km - p_within_10km', 'z_25'), ('p_within_50km - p_within_25km', 'z_50'), ('p_beyond_50km', 'z_far'), ('1 - p_any', 'z_none')))} FROM c"""))
def zone_probabilities(spark, sf_dir):
    events = catalog(spark, sf_dir).where(F.col("magnitude") >= P.m_c)
    p = [(F.col("event_id") * k) % 50 / 250.0 for k in (3, 7, 11, 13, 17)]
    found = metrics.disjoint_probabilities(events.select("event_id", *(c.alias(n) for n, c in metrics.zone_probabilities(p).items())))
    return found.select("event_id", *(geo.rounded(F.col(c)).alias(c) for c in found.columns[1:]))
