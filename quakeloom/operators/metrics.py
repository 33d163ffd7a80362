"""Exact forecast metrics over tables of scores, and the choice among model families.

Classification tables have label (0 or 1) and probability; regression tables actual and predicted.
`keys` are columns that name the table a row belongs to, such as family and target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.functions import geo

#: Weights of the choice, and metrics of which less is better.
CLASS_WEIGHTS = {"brier": 0.50, "ece": 0.25, "average_precision": 0.15, "roc_auc": 0.10}
REGRESSION_WEIGHTS = {"rmse": 0.50, "mae": 0.30, "r2": 0.20}
LESS_IS_BETTER = ("brier", "ece", "rmse", "mae")
#: Interior edges of ten equal bins of [0, 1], as IEEE doubles of linspace.
EDGES = tuple(i * 0.1 for i in range(1, 10))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def classification(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Brier score, log loss, precision and recall at one half, rates."""
    p, y = F.col("probability"), F.col("label")
    clipped = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    said, hit = p >= 0.5, (p >= 0.5) & (y == 1)
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n"),
        geo.rounded(F.avg((p - y) * (p - y))).alias("brier"),
        geo.rounded(-F.avg(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"),
        geo.rounded(_safe(F.count_if(hit), F.count_if(said))).alias("precision"),
        geo.rounded(_safe(F.count_if(hit), F.sum(y))).alias("recall"),
        geo.rounded(F.avg(y.cast("double"))).alias("positive_rate"),
        geo.rounded(F.avg(p)).alias("mean_probability"),
    )


def _by_value(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct probability: ranking metrics need no more."""
    return scores.groupBy(*keys, "probability").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def roc_auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve: the chance that a positive outranks a negative, ties half. Null with one class."""
    below = Window.partitionBy(*keys).orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _by_value(scores, keys).withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2.0))
    area = wins / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))
    return ranked.groupBy(*keys).agg(geo.rounded(area).alias("roc_auc"))


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Precision at each distinct threshold, weighted by the recall that it adds."""
    above = Window.partitionBy(*keys).orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _by_value(scores, keys).withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above)})
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return ranked.groupBy(*keys).agg(geo.rounded(gain / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def calibration_bin(p: Column, right_closed: bool = False) -> Column:
    """How many interior edges are at or below p (or strictly below, for right-closed bins)."""
    at = (lambda e: p > e) if right_closed else (lambda e: p >= e)
    return sum((at(F.lit(e)).cast("int") for e in EDGES), F.lit(0))


def reliability(scores: DataFrame, keys: list[str], right_closed: bool = False) -> DataFrame:
    """Per bin of ten: rows, mean probability and observed rate."""
    binned = scores.groupBy(*keys, calibration_bin(F.col("probability"), right_closed).alias("bin"))
    return binned.agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg(F.col("label").cast("double")).alias("observed_rate"))


def expected_calibration_error(scores: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("observed_rate"))) / F.sum("n")
    return reliability(scores, keys).groupBy(*keys).agg(geo.rounded(gap).alias("ece"))


def probability_histogram(scores: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    index = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(*keys, index.alias("bin")).agg(F.count("*").alias("n"))


def regression(scores: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, R2 and means over rows with an actual value; n is 0 where there is none."""
    a, p = F.col("actual"), F.when(F.col("actual").isNotNull(), F.col("predicted"))
    sse, sst = F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a)
    return scores.groupBy(*keys).agg(
        F.count(a).alias("n"),
        geo.rounded(F.avg(F.abs(a - p))).alias("mae"),
        geo.rounded(F.sqrt(F.avg((a - p) * (a - p)))).alias("rmse"),
        geo.rounded(1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
        geo.rounded(F.avg(a)).alias("mean_actual"),
        geo.rounded(F.avg(p)).alias("mean_predicted"),
    )


def long_form(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return wide.select(*keys, each.alias("x")).select(*keys, "x.*")


def weighted_scores(long: DataFrame, weights: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """keys, target, family, score: each metric scaled to 0..1 over the families of a target, then weighted.

    Missing values score 0, equal ones 1.
    """
    keys = keys or []
    over = Window.partitionBy(*keys, "target", "metric")
    low, high = F.min("value").over(over), F.max("value").over(over)
    share = (F.col("value") - low) / F.nullif(high - low, F.lit(0.0))
    scaled = F.when(F.col("value").isNull(), 0.0).when(low == high, 1.0).when(F.col("metric").isin(*LESS_IS_BETTER), 1.0 - share).otherwise(share)
    weight = F.coalesce(*(F.when(F.col("metric") == m, w) for m, w in weights.items()))
    used = long.where(F.col("metric").isin(*weights)).withColumn("part", weight * scaled)
    return used.groupBy(*keys, "target", "family").agg(geo.rounded(F.sum("part")).alias("score"))


def pick_per_target(scores: DataFrame) -> DataFrame:
    """The family of the highest score per target; of equals the first name."""
    best = F.min(F.struct((-F.col("score")).alias("least"), "family"))
    return scores.groupBy("target").agg(best.alias("b")).select("target", F.col("b.family").alias("family"), (-F.col("b.least")).alias("score"))


def pick_overall(scores: DataFrame) -> DataFrame:
    """The family of the highest total over all targets, as one row."""
    return scores.groupBy("family").agg(geo.rounded(F.sum("score")).alias("score")).orderBy(F.desc("score"), "family").limit(1)


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each (family, target, metric) between two long tables; either side may lack it."""
    a = before.select("family", "target", "metric", F.col("value").alias("before"))
    b = after.select("family", "target", "metric", F.col("value").alias("after"))
    change = F.col("after") - F.col("before")
    better = F.when(F.col("metric").isin(*LESS_IS_BETTER), change < 0).otherwise(change > 0)
    return a.join(b, ["family", "target", "metric"], "full_outer").withColumns({"delta": geo.rounded(change), "better": better})


def zone_probabilities(p: list[Column]) -> dict[str, Column]:
    """Cumulative probabilities from those of zones 0 (none) to 4 (beyond 50 km), kept in [0, 1]."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return {
        "p_any": clip(p[1] + p[2] + p[3] + p[4]), "p_within_10km": clip(p[1]), "p_within_25km": clip(p[1] + p[2]),
        "p_within_50km": clip(p[1] + p[2] + p[3]), "p_beyond_50km": clip(p[4]),
    }


def disjoint_probabilities(df: DataFrame) -> DataFrame:
    """Probabilities of single zones from cumulative ones."""
    c = F.col
    return df.withColumns({"z_10": c("p_within_10km"), "z_25": c("p_within_25km") - c("p_within_10km"), "z_50": c("p_within_50km") - c("p_within_25km"), "z_far": c("p_beyond_50km"), "z_none": 1.0 - c("p_any")})
