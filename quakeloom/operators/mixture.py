"""Gaussian mixtures of log10 eta, and the link threshold between their components."""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Component = tuple[float, float, float]  # weight, mean, sigma


def _vectors(linked: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["log10_eta"], outputCol="features").transform(linked.where("log10_eta IS NOT NULL").select("log10_eta"))


def components(linked: DataFrame, k: int = 2, seed: int = 42) -> tuple[list[Component], float, int]:
    """The fitted components by mean, the log likelihood and the number of events."""
    if k == 1:
        n, mean, sigma = linked.agg(F.count("log10_eta"), F.avg("log10_eta"), F.stddev_pop("log10_eta")).first()
        return [(1.0, mean, sigma)], -n / 2 * (math.log(2 * math.pi * sigma * sigma) + 1), n
    rows = _vectors(linked)
    model = GaussianMixture(k=k, seed=seed, maxIter=200, tol=1e-6).fit(rows)
    found = [(w, float(g.mean[0]), math.sqrt(float(g.cov.toArray()[0, 0]))) for w, g in zip(model.weights, model.gaussians)]
    return sorted(found, key=lambda c: c[1]), model.summary.logLikelihood, rows.count()


def information(log_likelihood: float, n: int, k: int) -> tuple[float, float]:
    """AIC and BIC of k components in one dimension, which have 3k - 1 free numbers."""
    free = 3 * k - 1
    return 2 * free - 2 * log_likelihood, free * math.log(n) - 2 * log_likelihood


def crossover(low: Component, high: Component) -> float:
    """Where both weighted densities are equal: between the means, or else the root nearest their middle."""
    (w1, m1, s1), (w2, m2, s2) = low, high
    a = 1 / (2 * s1 * s1) - 1 / (2 * s2 * s2)
    b = m2 / (s2 * s2) - m1 / (s1 * s1)
    c = m1 * m1 / (2 * s1 * s1) - m2 * m2 / (2 * s2 * s2) - math.log(w1 * s2 / (w2 * s1))
    if abs(a) < 1e-12:
        return -c / b
    inner = b * b - 4 * a * c
    if inner < 0:
        return (m1 + m2) / 2
    roots = [(-b + sign * math.sqrt(inner)) / (2 * a) for sign in (-1, 1)]
    between = [r for r in roots if min(m1, m2) <= r <= max(m1, m2)]
    return between[0] if between else min(roots, key=lambda r: abs(r - (m1 + m2) / 2))


def fit(linked: DataFrame, seed: int = 42) -> DataFrame:
    """One row per number of components 1..3: AIC, BIC; with two: parameters and the threshold log10_eta0."""
    rows, threshold = [], None
    for k in (1, 2, 3):
        found, log_likelihood, n = components(linked, k, seed)
        aic, bic = information(log_likelihood, n, k)
        threshold = crossover(*found) if k == 2 else None
        rows += [(k, aic, bic, i, *c, threshold) for i, c in enumerate(found)]
    return linked.sparkSession.createDataFrame(rows, "k int, aic double, bic double, component int, weight double, mean double, sigma double, log10_eta0 double")


def counts(linked: DataFrame, width: float = 0.01) -> DataFrame:
    """x (middle of a bin) and n of log10 eta: as many rows as there are bins, whatever the number of events."""
    binned = linked.where("log10_eta IS NOT NULL").groupBy(F.floor(F.col("log10_eta") / width + 0.5).alias("i")).agg(F.count("*").cast("double").alias("n"))
    return binned.select((F.col("i") * F.lit(width)).alias("x"), "n")


def _log_density(x: Column, weight: Column, mean: Column, variance: Column) -> Column:
    return F.log(weight) - 0.5 * F.log(variance * (2 * math.pi)) - (x - mean) * (x - mean) / (variance * 2.0)


def crossover_of(w1: Column, m1: Column, v1: Column, w2: Column, m2: Column, v2: Column) -> Column:
    """`crossover` of two components with these variances, as a column."""
    a, b = 0.5 / v1 - 0.5 / v2, m2 / v2 - m1 / v1
    c = m1 * m1 / (v1 * 2.0) - m2 * m2 / (v2 * 2.0) - F.log(w1 / w2) - 0.5 * F.log(v2 / v1)
    middle, inner = (m1 + m2) / 2.0, b * b - a * c * 4.0
    low, high = (-b - F.sqrt(inner)) / (a * 2.0), (-b + F.sqrt(inner)) / (a * 2.0)
    inside = lambda r: (r >= F.least(m1, m2)) & (r <= F.greatest(m1, m2))
    nearest = F.when(F.abs(low - middle) <= F.abs(high - middle), low).otherwise(high)
    return F.when(F.abs(a) < 1e-12, -c / b).when(inner < 0, middle).when(inside(low), low).when(inside(high), high).otherwise(nearest)


def expectation_maximisation(linked: DataFrame, rounds: int = 25, width: float = 0.01, least_variance: float = 1e-4) -> DataFrame:
    """Two components of log10 eta, one row each (component, weight, mean, sigma), with the threshold log10_eta0, AIC and BIC.

    The start is fixed: means at the lower and upper quartile, the variance of all, half the weight each. A round takes
    three sums over the bins, all rounds run inside one row that holds the bins. No row without a log10_eta, or if all are equal.
    """
    bins = counts(linked, width)
    upto = F.sum("n").over(Window.orderBy("x"))  # over bins, a fixed number
    placed = bins.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    whole = placed.agg(
        F.array_sort(F.collect_list(F.struct("x", "n"))).alias("bins"), F.max("total").alias("N"), F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("sxx"),
        F.min(F.when(F.col("upto") >= F.col("total") * 0.25, F.col("x"))).alias("q1"), F.min(F.when(F.col("upto") >= F.col("total") * 0.75, F.col("x"))).alias("q3"),
    ).withColumn("v", F.col("sxx") / F.col("N") - F.col("sx") / F.col("N") * F.col("sx") / F.col("N")).where("q1 < q3")
    start = F.struct(F.lit(0.5).alias("w1"), F.col("q1").alias("m1"), F.col("v").alias("v1"), F.col("q3").alias("m2"), F.col("v").alias("v2"))
    first = lambda s, x: _log_density(x, s["w1"], s["m1"], s["v1"])
    second = lambda s, x: _log_density(x, 1.0 - s["w1"], s["m2"], s["v2"])

    def round_(s: Column, _: Column) -> Column:
        def add(t: Column, b: Column) -> Column:
            r = b["n"] / (F.exp(second(s, b["x"]) - first(s, b["x"])) + 1.0)
            return F.struct((t["r"] + r).alias("r"), (t["rx"] + r * b["x"]).alias("rx"), (t["rxx"] + r * b["x"] * b["x"]).alias("rxx"))

        def new(t: Column) -> Column:
            r1, r2 = t["r"], F.col("N") - t["r"]
            m1, m2 = t["rx"] / r1, (F.col("sx") - t["rx"]) / r2
            variance = lambda xx, r, m: F.greatest(xx / r - m * m, F.lit(least_variance))
            return F.struct((r1 / F.col("N")).alias("w1"), m1.alias("m1"), variance(t["rxx"], r1, m1).alias("v1"), m2.alias("m2"), variance(F.col("sxx") - t["rxx"], r2, m2).alias("v2"))

        zero = F.struct(*(F.lit(0.0).alias(c) for c in ("r", "rx", "rxx")))
        return F.aggregate("bins", zero, add, new)

    fitted = whole.select("bins", "N", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_).alias("s"))
    s = F.col("s")
    likelihood = F.aggregate("bins", F.lit(0.0), lambda t, b: t + b["n"] * (F.greatest(first(s, b["x"]), second(s, b["x"])) + F.log1p(F.exp(-F.abs(first(s, b["x"]) - second(s, b["x"]))))))
    told = fitted.select("s", "N", likelihood.alias("ll"), crossover_of(s["w1"], s["m1"], s["v1"], 1.0 - s["w1"], s["m2"], s["v2"]).alias("log10_eta0"))
    parts = F.array(
        F.struct(F.lit(0).alias("component"), s["w1"].alias("weight"), s["m1"].alias("mean"), F.sqrt(s["v1"]).alias("sigma")),
        F.struct(F.lit(1).alias("component"), (1.0 - s["w1"]).alias("weight"), s["m2"].alias("mean"), F.sqrt(s["v2"]).alias("sigma")),
    )
    return told.select(F.explode(parts).alias("c"), "log10_eta0", (10.0 - F.col("ll") * 2.0).alias("aic"), (F.log("N") * 5.0 - F.col("ll") * 2.0).alias("bic")).select("c.*", "log10_eta0", "aic", "bic")
