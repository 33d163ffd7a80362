"""The training set, and queries that fit models on it. Sums inside the fits depend on the partitions, so that
SQL can match the training set only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.operators import backtests, clusters, features, mixture, models, sampling, skew, targets
from quakeloom.plans import catalog_queries, feature_queries
from quakeloom.plans.cluster_queries import linked
from quakeloom.plans.oracle import KEPT, LINKED, r6, sql
from quakeloom.session import cut

SIZE = models.Size(trees=20, depth=5, rounds=8)
#: Families that stop by themselves are given as many rounds, as deep trees and as much patience as the library's default.
STOPPED_SIZE = models.Size()


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, sort_time, 65 features and 10 targets of every event."""
    links = linked(spark, sf_dir)
    return features.build(links).join(cut(targets.build(cut(clusters.assign(links)))), "event_id")


def gmm_eta0(spark, sf_dir):
    return mixture.fit(linked(spark, sf_dir).select("log10_eta"))


def training_rows(spark, sf_dir):
    """The training set; doubles rounded."""
    rows = training_set(spark, sf_dir)
    return rows.select(*(geo.rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def _scores(family: str):
    def query(spark, sf_dir):
        parts = sampling.checked_split(cut(training_set(spark, sf_dir)))
        return models.score(models.train(parts["train"], family, SIZE), parts["validate"]).select("event_id", *models.CLASSES, *(f"predicted_{t}" for t in models.REGRESSION))

    return query


def _stopped(spark, sf_dir, family: str):
    parts = sampling.checked_split(cut(training_set(spark, sf_dir)))
    return models.train(parts["train"], family, STOPPED_SIZE, stop_on=parts["validate"]), parts["test"]


def _stopped_scores(family: str):
    def query(spark, sf_dir):
        """Scores of the test years; the validation year has stopped the boosting."""
        model, test = _stopped(spark, sf_dir, family)
        return models.score(model, test).select("event_id", *models.CLASSES, *(f"predicted_{t}" for t in models.REGRESSION))

    return query


def boosting_rounds(spark, sf_dir):
    """Loss of the validation year after each round of every target of the oblivious family."""
    return models.stopping(_stopped(spark, sf_dir, "oblivious")[0])


def ensemble_scores(spark, sf_dir):
    parts = sampling.checked_split(cut(training_set(spark, sf_dir)))
    fitted = {f: models.train(parts["train"], f, SIZE) for f in sorted(set(models.ENSEMBLE.values()))}
    return models.score_ensemble(fitted, parts["validate"]).select("event_id", *models.CLASSES, *(f"predicted_{t}" for t in models.REGRESSION))


def backtest_metrics(spark, sf_dir):
    parts = sampling.checked_split(cut(training_set(spark, sf_dir)))
    return models.backtest(parts["train"], parts["validate"], size=SIZE)


def calibration_study(spark, sf_dir):
    parts = sampling.checked_split(cut(training_set(spark, sf_dir)))
    return models.calibration_study(parts["train"], parts["validate"], parts["test"], SIZE)


def skew_effect_scores(spark, sf_dir):
    """The effect of the serving form of all features on the forest's scores of the validation year."""
    k = feature_queries.kept(spark, sf_dir)
    rows = cut(training_set(spark, sf_dir))
    parts = sampling.checked_split(rows)
    asked = k.join(parts["validate"].select("event_id"), "event_id", "left_semi")
    return skew.effect(skew.paired_scores(models.train(parts["train"], "forest", SIZE), parts["validate"], cut(features.serve(asked, k))), ["target"])


BACKTEST_YEARS, BACKTEST_FAMILIES = [2025, 2026], ("forest", "gbt", "logit")


def _rolled(spark, sf_dir):
    rows = cut(training_set(spark, sf_dir))
    return rows, cut(backtests.measured(*map(cut, backtests.rolling(rows, BACKTEST_YEARS, BACKTEST_FAMILIES, SIZE))))


def backtest_by_year(spark, sf_dir):
    """Metrics of each family and target in each of two years, learned from the years before."""
    return _rolled(spark, sf_dir)[1]


def pick_report(spark, sf_dir):
    """A JSON document a year: picks, their scores and metrics from the backtests of that year."""
    rows, long = _rolled(spark, sf_dir)
    return backtests.report(long, backtests.pools(rows, BACKTEST_YEARS, BACKTEST_FAMILIES))


def serve_event_json(spark, sf_dir):
    """A JSON forecast of every event since 2026 by the forest family."""
    parts = sampling.checked_split(cut(training_set(spark, sf_dir)))
    return models.as_json(models.score(models.train(parts["train"], "forest", SIZE), parts["test"]))


QUERIES = {
    "gmm_eta0": gmm_eta0,
    "training_rows": training_rows,
    "forest_scores": _scores("forest"),
    "gbt_scores": _scores("gbt"),
    "logit_scores": _scores("logit"),
    "boosted_scores": _stopped_scores("boosted"),
    "oblivious_scores": _stopped_scores("oblivious"),
    "boosting_rounds": boosting_rounds,
    "ensemble_scores": ensemble_scores,
    "backtest_metrics": backtest_metrics,
    "calibration_study": calibration_study,
    "skew_effect_scores": skew_effect_scores,
    "backtest_by_year": backtest_by_year,
    "pick_report": pick_report,
    "serve_event_json": serve_event_json,
}
#: The SQL of each part of the training set, by event.
_PARTS = {
    **{n: feature_queries.ORACLE_SQL[n] for n in ("parent_features", "global_activity", "traffic_ratio", "local_activity", "nearest_recent", "local_b_value", "forecast_targets")},
    "time_parts": catalog_queries.ORACLE_SQL["time_parts"],
    "physics": catalog_queries.ORACLE_SQL["advanced_features"],
    "base": sql(KEPT, f"SELECT event_id, sort_time, {', '.join(f'{r6(c)} AS {c}' for c in ('magnitude', 'depth_km', 'latitude', 'longitude'))} FROM kept"),
    "eta": sql(LINKED, f"SELECT event_id, {r6('pow(10e0, log10_eta)')} AS eta FROM linked"),
}
_RENAMED = {f"nearest_recent_event_{c}_past_30d": f"nearest_recent.{c}" for c in ("distance_km", "magnitude", "age_days")} | {"magnitude": "base.magnitude"}
_COLUMNS = ["event_id", "sort_time", *features.names(), *targets.names()]
ORACLE_SQL = {
    "training_rows": f"SELECT {', '.join(f'{_RENAMED.get(c, c)} AS {c}' for c in _COLUMNS)} FROM ({_PARTS['base']}) base "
    + " ".join(f"JOIN ({part}) {name} USING (event_id)" for name, part in _PARTS.items() if name != "base")
}
