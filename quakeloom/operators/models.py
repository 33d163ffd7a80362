"""Model families for the forecast targets, their scores, backtests and ensemble.

Families are named after what they are: forest (random forests), gbt (boosted trees; the zone from
binary models of "zone 1 to k"), logit (multinomial logistic and linear regression). These
fill missing values by the median and add 0/1 columns that tell where, since none takes nulls.
boosted and oblivious (trees with one split a level) are of operators/boosting.py: softmax over the
zones, nulls as they are, as many rounds as rows that weren't learned from ask for.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.operators import boosting, isotonic, metrics, targets
from quakeloom.operators.features import names as feature_names

ZONE = "aftershock_spatial_zone_24h"
REGRESSION = ("max_aftershock_mag_24h", "nearest_aftershock_distance_km_24h", "median_aftershock_distance_km_24h", "p90_aftershock_distance_km_24h")
#: Distances are fitted as log(1 + km).
LOGGED = REGRESSION[1:]
CLASSES = {"p_any": "aftershock_24h", "p_within_10km": "aftershock_within_10km_24h", "p_within_25km": "aftershock_within_25km_24h", "p_within_50km": "aftershock_within_50km_24h", "p_beyond_50km": "aftershock_beyond_50km_24h"}
#: Features that may be null.
SPARSE = tuple(n for n in feature_names() if n.startswith(("parent_", "nearest_recent")) or n in ("eta", "log10_eta", "log10_rescaled_time", "log10_rescaled_distance"))
STOPPED = ("boosted", "oblivious")
FAMILIES = ("forest", "gbt", "logit", *STOPPED)
ZONES = 5
#: Which family serves which target when all are used together.
ENSEMBLE = {ZONE: "gbt", "max_aftershock_mag_24h": "forest", "nearest_aftershock_distance_km_24h": "gbt", "median_aftershock_distance_km_24h": "forest", "p90_aftershock_distance_km_24h": "gbt"}


@dataclass(frozen=True)
class Size:
    trees: int = 60
    depth: int = 6
    rounds: int = 30
    leaf: int = 2
    seed: int = 42
    most_rounds: int = 200
    patience: int = 10


_FITTED = {
    "forest": (RandomForestClassificationModel, RandomForestRegressionModel),
    "gbt": (GBTClassificationModel, GBTRegressionModel),
    "logit": (LogisticRegressionModel, LinearRegressionModel),
    **dict.fromkeys(STOPPED, (boosting.Boosted, boosting.Boosted)),
}


def _save(stage, path: str) -> None:
    if isinstance(stage, boosting.Boosted):
        stage.save(path)
    else:
        stage.write().overwrite().save(path)


@dataclass
class Model:
    """Fitted stages of one family: the preparation, the zone models and the regressors by target."""

    family: str
    prepare: PipelineModel
    zone: list = field(default_factory=list)
    regressors: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.prepare.write().overwrite().save(f"{path}/prepare")
        for i, m in enumerate(self.zone):
            if m is not None:
                _save(m, f"{path}/zone_{i}")
        for t, m in self.regressors.items():
            _save(m, f"{path}/{t}")
        told = {"family": self.family, "zone": [m is not None for m in self.zone], "regressors": sorted(self.regressors)}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(path: str) -> Model:
        """What `save` wrote."""
        told = json.loads(SparkSession.active().read.text(f"{path}/model").first()[0])
        classifier, regressor = _FITTED[told["family"]]
        zone = [classifier.load(f"{path}/zone_{i}") if there else None for i, there in enumerate(told["zone"])]
        return Model(told["family"], PipelineModel.load(f"{path}/prepare"), zone, {t: regressor.load(f"{path}/{t}") for t in told["regressors"]})


def _prepare(features: list[str]) -> Pipeline:
    sparse = [f for f in features if f in SPARSE]
    dense = ", ".join([*(f"cast(`{f}` as double) AS `x_{f}`" for f in features), *(f"cast(`{f}` IS NULL as double) AS `none_{f}`" for f in sparse)])
    filled = [f"x_{f}" for f in sparse]
    # a column that is null in all rows has no median; it is filled with 0 after
    whole = ", ".join(f"coalesce(`f_{f}`, 0D) AS `g_{f}`" for f in sparse)
    stages = [SQLTransformer(statement=f"SELECT *, {dense} FROM __THIS__")]
    if sparse:
        stages += [Imputer(strategy="median", inputCols=filled, outputCols=[f"f_{f}" for f in sparse]), SQLTransformer(statement=f"SELECT *, {whole} FROM __THIS__")]
    inputs = [f"g_{f}" if f in sparse else f"x_{f}" for f in features] + [f"none_{f}" for f in sparse]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")])


def _classifiers(family: str, size: Size) -> Callable[[], object]:
    return {
        "forest": lambda: RandomForestClassifier(numTrees=size.trees, maxDepth=size.depth, minInstancesPerNode=size.leaf, seed=size.seed),
        "gbt": lambda: GBTClassifier(maxIter=size.rounds, maxDepth=4, stepSize=0.1, seed=size.seed),
        "logit": lambda: LogisticRegression(maxIter=50, regParam=1e-3, family="multinomial"),
    }[family]


def _regressor(family: str, size: Size):
    return {
        "forest": lambda: RandomForestRegressor(numTrees=size.trees, maxDepth=size.depth, minInstancesPerNode=2 * size.leaf, seed=size.seed),
        "gbt": lambda: GBTRegressor(maxIter=size.rounds, maxDepth=4, stepSize=0.1, seed=size.seed),
        "logit": lambda: LinearRegression(maxIter=50, regParam=1e-2),
    }[family]()


def _train_stopped(rows: DataFrame, family: str, size: Size, features: list[str], stop_on: DataFrame | None) -> Model:
    if stop_on is None:
        late = F.lit(rows.agg(F.percentile_approx("sort_time", 0.9)).first()[0])
        rows, stop_on = rows.where(F.col("sort_time") <= late), rows.where(F.col("sort_time") > late)
    how = boosting.Boosting(rounds=size.most_rounds, patience=size.patience, depth=size.depth, symmetric=family == "oblivious")
    labels = {ZONE: (F.col(ZONE), ZONES)} | {t: (F.log1p(t) if t in LOGGED else F.col(t), 0) for t in REGRESSION}
    varied = {t: of for t, of in labels.items() if rows.where(F.col(t).isNotNull()).select(t).distinct().limit(2).count() > 1}
    fitted = boosting.fit_all(rows, varied, features, stop_on, how) if varied else {}
    return Model(family, Pipeline(stages=[]).fit(rows), [fitted.pop(ZONE)] if ZONE in fitted else [], fitted)


def train(rows: DataFrame, family: str, size: Size = Size(), features: list[str] | None = None, stop_on: DataFrame | None = None) -> Model:
    """A family fitted to rows with features and targets. Targets with one value only are skipped.

    boosted and oblivious stop by the loss on `stop_on`; without it, on the latest tenth of `rows`, from which they
    then don't learn. The other families learn from all `rows` and have no use for it."""
    features = features or feature_names()
    if family in STOPPED:
        return _train_stopped(rows, family, size, features, stop_on)
    prepare = _prepare(features).fit(rows)
    ready = prepare.transform(rows).select("features", *targets.names()).cache()
    model = Model(family, prepare)
    seen = {r[0] for r in ready.select(ZONE).distinct().collect()}  # five zones at most
    new = _classifiers(family, size)
    if len(seen) > 1:
        if family == "gbt":
            for k in range(1, 5):
                label = ready.withColumn("label", F.col(ZONE).between(1, k).cast("double"))
                model.zone.append(new().fit(label) if label.select("label").distinct().count() > 1 else None)
        else:
            model.zone.append(new().fit(ready.withColumn("label", F.col(ZONE).cast("double"))))
    for target in REGRESSION:
        positive = ready.where(F.col(target).isNotNull())
        value = F.log1p(target) if target in LOGGED else F.col(target)
        if positive.select(target).distinct().limit(2).count() > 1:
            model.regressors[target] = _regressor(family, size).fit(positive.withColumn("label", value))
    ready.unpersist()
    return model


def _probabilities(model: Model, ready: DataFrame) -> DataFrame:
    """`ready` with the cumulative probabilities of CLASSES."""
    clean = lambda df, i: df.withColumnsRenamed({"probability": f"_p{i}"}).drop("rawPrediction", "prediction")
    if model.family == "gbt":
        for i, m in enumerate(model.zone):
            ready = clean(m.transform(ready), i).withColumn(f"_p{i}", vector_to_array(f"_p{i}")[1]) if m else ready.withColumn(f"_p{i}", F.lit(0.0))
        # models of nested events are fitted apart: cumulative probabilities are kept from falling
        upto = [F.greatest(*(F.col(f"_p{j}") for j in range(i + 1))) if i else F.col("_p0") for i in range(4)]
        p = [1 - upto[3], upto[0], *(upto[i] - upto[i - 1] for i in (1, 2, 3))]
        return ready.withColumns(metrics.zone_probabilities(p)).drop(*(f"_p{i}" for i in range(4)))
    ready = clean(model.zone[0].transform(ready), 0)
    each = F.col("_p0") if model.family in STOPPED else vector_to_array("_p0")
    p = [F.coalesce(F.get(each, i), F.lit(0.0)) for i in range(ZONES)]
    return ready.withColumns(metrics.zone_probabilities(p)).drop("_p0")


def score(model: Model, rows: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """`rows` with the probabilities of CLASSES and predicted_ values; distances back in km, not below 0.

    Targets that `train` skipped get nulls."""
    columns = rows.columns
    ready = model.prepare.transform(rows)
    ready = ready if model.family in STOPPED else ready.select(*columns, "features")
    wanted = only or (ZONE, *REGRESSION)
    if ZONE in wanted and model.zone:
        ready = _probabilities(model, ready)
    elif ZONE in wanted:
        ready = ready.withColumns({p: F.lit(None).cast("double") for p in CLASSES})
    for target in REGRESSION:
        if target in wanted and target in model.regressors:
            value = F.greatest(F.expm1("prediction"), F.lit(0.0)) if target in LOGGED else F.col("prediction")
            ready = model.regressors[target].transform(ready).withColumn(f"predicted_{target}", value).drop("prediction")
        elif target in wanted:
            ready = ready.withColumn(f"predicted_{target}", F.lit(None).cast("double"))
    return ready if model.family in STOPPED else ready.drop("features")


def score_ensemble(models: dict[str, Model], rows: DataFrame, choice: dict[str, str] = ENSEMBLE) -> DataFrame:
    """Each target by its chosen family."""
    for target, family in choice.items():
        rows = score(models[family], rows, (target,))
    return rows


def score_table(scored: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """Long tables of the metrics operators: classes and regressions."""
    classes = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("label"), F.col(p).alias("probability")) for p, t in CLASSES.items())))
    values = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"), F.col(f"predicted_{t}").alias("predicted")) for t in REGRESSION if f"predicted_{t}" in scored.columns)))
    long = (scored.select(F.lit(family).alias("family"), x.alias("x")).select("family", "x.*") for x in (classes, values))
    return tuple(df.where(f"{c} IS NOT NULL") for df, c in zip(long, ("probability", "predicted")))


def backtest(train_rows: DataFrame, test_rows: DataFrame, families: tuple[str, ...] = FAMILIES, size: Size = Size()) -> DataFrame:
    """family, target, metric, value of families fitted on one part and scored on another."""
    keys, parts = ["family", "target"], []
    for family in families:
        classes, values = score_table(score(train(train_rows, family, size), test_rows), family)
        found = [(metrics.classification(classes, keys), ["brier", "log_loss"]), (metrics.roc_auc(classes, keys), ["roc_auc"]), (metrics.average_precision(classes, keys), ["average_precision"]),
                 (metrics.expected_calibration_error(classes, keys), ["ece"]), (metrics.regression(values, keys), ["mae", "rmse", "r2"])]
        parts += [metrics.long_form(df, keys, names) for df, names in found]
    return reduce(DataFrame.unionByName, parts)


def importance(model: Model, features: list[str] | None = None) -> list[tuple[str, float]]:
    """Features of a family's first zone model by falling importance; of logit, the sum of their absolute coefficients; of
    boosted and oblivious, the gain."""
    features = features or feature_names()
    names = features + [f"missing {f}" for f in features if f in SPARSE]
    fitted = next((m for m in model.zone if m is not None), None)
    if fitted is None:
        return []
    if model.family in STOPPED:
        return sorted(fitted.importance().items(), key=lambda x: (-x[1], x[0]))
    values = abs(fitted.coefficientMatrix.toArray()).sum(axis=0) if model.family == "logit" else fitted.featureImportances.toArray()
    return sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))


def calibration_scores(train_rows: DataFrame, calibrate_rows: DataFrame, test_rows: DataFrame, size: Size = Size()) -> DataFrame:
    """event_id, target, path, label, probability on the test rows, for every class target that has both labels in training:
    a forest at natural prevalence, one weighted to balance, and the weighted one mended by isotonic regression."""
    prepare = _prepare(feature_names()).fit(train_rows)
    ready = lambda df: prepare.transform(df).select("event_id", "features", *CLASSES.values())
    rows, between, asked = ready(train_rows).cache(), ready(calibrate_rows), ready(test_rows)
    shares = rows.agg(*(F.avg(t).alias(t) for t in CLASSES.values())).first()
    learned, found = [], []
    for target in (t for t in CLASSES.values() if 0 < (shares[t] or 0) < 1):
        label = F.col(target).cast("double")
        weight = F.when(label == 1, 0.5 / shares[target]).otherwise(0.5 / (1 - shares[target]))
        forest = RandomForestClassifier(numTrees=size.trees, maxDepth=size.depth, minInstancesPerNode=size.leaf, seed=size.seed)
        labelled = rows.where(label.isNotNull()).withColumns({"label": label, "w": weight})
        natural, balanced = forest.fit(labelled), forest.copy({forest.weightCol: "w"}).fit(labelled)
        p = lambda m, df, path: m.transform(df).select("event_id", F.lit(target).alias("target"), F.lit(path).alias("path"), F.col(target).cast("int").alias("label"), vector_to_array("probability")[1].alias("probability"))  # noqa: E731, B023
        learned.append(p(balanced, between, "weighted"))
        found += [p(natural, asked, "natural"), p(balanced, asked, "weighted")]
    rows.unpersist()
    if not found:
        return train_rows.sparkSession.createDataFrame([], "event_id long, target string, path string, label int, probability double")
    blocks, both = isotonic.fit(reduce(DataFrame.unionByName, learned), ["target"]), reduce(DataFrame.unionByName, found)
    mended = isotonic.calibrate(both.where("path = 'weighted'"), blocks, ["target"])
    return both.unionByName(mended.select("event_id", "target", F.lit("weighted and isotonic").alias("path"), "label", F.col("calibrated").alias("probability")))


def calibration_table(scores: DataFrame) -> DataFrame:
    """target, path and metrics of calibration_scores, and a row per path with the means over its targets (target: all)."""
    keys = ["target", "path"]
    known = scores.where("label IS NOT NULL AND probability IS NOT NULL")
    each = metrics.classification(known, keys).join(metrics.expected_calibration_error(known, keys), keys).join(metrics.roc_auc(known, keys), keys)
    told = ["brier", "log_loss", "ece", "roc_auc"]
    means = each.groupBy("path").agg(F.sum("n").alias("n"), *(geo.rounded(F.avg(c)).alias(c) for c in told))
    return each.select(*keys, "n", *told).unionByName(means.select(F.lit("all").alias("target"), "path", "n", *told))


def calibration_study(train_rows: DataFrame, calibrate_rows: DataFrame, test_rows: DataFrame, size: Size = Size()) -> DataFrame:
    """calibration_table of forests that learn from one part, are calibrated on another and judged on a third."""
    return calibration_table(calibration_scores(train_rows, calibrate_rows, test_rows, size))


def stopping(model: Model) -> DataFrame:
    """family, target, round, loss on the rows that stopped it, and whether the round was kept."""
    fitted = {ZONE: model.zone[0]} if model.zone else {}
    rows = [(model.family, target, n, float(loss), n <= len(m.trees)) for target, m in (fitted | model.regressors).items() for n, loss in enumerate(m.losses)]
    return SparkSession.active().createDataFrame(rows, "family string, target string, round int, loss double, kept boolean")


def as_json(scored: DataFrame) -> DataFrame:
    """event_id and a JSON document per scored event; missing values are null."""
    p = F.struct(*(geo.rounded(F.col(c)).alias(t) for c, t in CLASSES.items()))
    values = F.struct(*(geo.rounded(F.col(f"predicted_{t}")).alias(t) for t in REGRESSION if f"predicted_{t}" in scored.columns))
    zones = metrics.disjoint_probabilities(scored)
    disjoint = F.struct(*(geo.rounded(F.col(c)).alias(n) for c, n in (("z_10", "within_10km"), ("z_25", "from_10_to_25km"), ("z_50", "from_25_to_50km"), ("z_far", "beyond_50km"), ("z_none", "none"))))
    return zones.select("event_id", F.to_json(F.struct("event_id", p.alias("probabilities"), disjoint.alias("zones"), values.alias("regression")), {"ignoreNullFields": "false"}).alias("document"))
