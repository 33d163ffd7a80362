"""Operators without SQL twins: range joins, serving, samples, metrics, models, streams, files."""

import os
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.functions.ordering import counted_before, numbered
from quakeloom.operators import disc_sums, features, metrics, mixture, models, neighbors, range_join, reports, sampling, targets
from quakeloom.plans import workflow
from quakeloom.session import cut
from quakeloom.sources import sinks
from quakeloom.streaming import scorer
from tests.test_fixtures import CSV

COLUMNS = "event_id long, sort_time long, latitude double, longitude double, depth_km double, magnitude double"


def catalog(spark, n=400, seed=1, span=40 * 86400):
    rng = random.Random(seed)
    rows = [(i, 1514764800 + rng.randrange(span), round(rng.uniform(-61, 70), 3) if i % 9 == 0 else round(rng.gauss(10, 0.7), 3), round(rng.gauss(121, 0.7), 3), float(i % 80), round(1 + rng.expovariate(1.2), 1)) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS), rows


def km(a, b):
    x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(x)))


@pytest.mark.parametrize("radius", [10, 100])
def test_near_past_finds_all_pairs(spark, radius):
    df, rows = catalog(spark)
    got = {(r.event_id, r.p_event_id) for r in range_join.near_past(df, df, radius, 7 * 86400).collect()}
    box = lambda a, b: abs(a[2] - b[2]) <= radius / 111.32 and abs(a[3] - b[3]) <= radius / (111.32 * max(math.cos(math.radians(a[2])), 0.1))
    expected = {(a[0], b[0]) for a in rows for b in rows if (b[1], b[0]) < (a[1], a[0]) and b[1] >= a[1] - 7 * 86400 and box(a, b) and km(a, b) <= radius}
    assert got == expected and len(expected) > 50


def test_numbers_and_counts_across_buckets(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(500)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t long")
    got = {r.id: r.row_no for r in numbered(df, "t", "id", bucket_seconds=37).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    ask = spark.createDataFrame([(q,) for q in range(-5, 520, 7)], "q long")
    got = {r.q: r.n for r in counted_before(df, "t", ask, "q", ["q"], "n", bucket_seconds=37).collect()}
    assert got == {q: sum(t < q for _, t in rows) for q in range(-5, 520, 7)}


def test_serving_agrees_with_training(spark):
    df, _ = catalog(spark, 250)
    df = df.dropDuplicates(["sort_time"])
    batch, serving = features.build(neighbors.with_parents(df)), features.serve(df, df)
    same = [f for f in features.names() if f != "local_b_value_50km_3y"]
    found = {r.feature: r for r in features.skew(batch, serving, same).collect()}
    assert len(found) == 64 and all(r.close_percent == 100 for r in found.values())


def test_samples(spark):
    df, _ = catalog(spark, 100)
    assert sampling.hash_sample(df, 10).collect() == sampling.hash_sample(df, 10).collect()
    labelled = df.withColumn("y", (F.col("event_id") < 10).cast("int"))
    assert sampling.balanced_sample(labelled, "y", 40).agg(F.sum("y"), F.count("*")).first()[:] == (10, 40)
    assert sampling.balanced_sample(labelled, "y", 10).agg(F.sum("y"), F.count("*")).first()[:] == (5, 10)
    assert sampling.chronological_sample(df, 500).count() == 100
    picked = [r.event_id for r in sampling.chronological_sample(df, 5).orderBy("sort_time", "event_id").collect()]
    order = [r.event_id for r in df.orderBy("sort_time", "event_id").collect()]
    assert picked == [order[i] for i in (0, 24, 49, 74, 99)]
    with pytest.raises(ValueError, match="test"):
        sampling.checked_split(df)


def test_metric_corner_cases(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 0, 0.1 * 3), ("a", 1, 1.0), ("b", 1, 0.5), ("c", 0, 0.2)], "k string, label int, probability double")
    bins = {(r.k, r.bin): r.n for r in metrics.reliability(df, ["k"]).collect()}
    assert bins == {("a", 2): 1, ("a", 3): 1, ("a", 9): 1, ("b", 5): 1, ("c", 2): 1}
    auc = {r.k: r.roc_auc for r in metrics.roc_auc(df, ["k"]).collect()}
    assert auc["b"] is None and auc["c"] is None
    assert {r.k: r.average_precision for r in metrics.average_precision(df, ["k"]).collect()}["c"] is None
    empty = spark.createDataFrame([("a", None, 1.0)], "k string, actual double, predicted double")
    row = metrics.regression(empty, ["k"]).first()
    assert (row.n, row.mae, row.r2, row.mean_predicted) == (0, None, None, None)


def test_pick(spark):
    long = spark.createDataFrame([("t", "a", "rmse", 1.0), ("t", "b", "rmse", 2.0), ("t", "c", "rmse", None), ("t", "a", "r2", 0.5), ("t", "b", "r2", 0.5), ("t", "c", "r2", 0.5)], "target string, family string, metric string, value double")
    scores = {r.family: r.score for r in metrics.weighted_scores(long, metrics.REGRESSION_WEIGHTS).collect()}
    assert scores == {"a": 0.7, "b": 0.2, "c": 0.2}
    best = metrics.weighted_scores(long, metrics.REGRESSION_WEIGHTS)
    assert metrics.pick_per_target(best).first().family == "a" == metrics.pick_overall(best).first().family
    text = reports.comparison_table(metrics.deltas(long, long.where("family <> 'b'").withColumn("value", F.col("value") + 1)))
    assert "| t | rmse | a | 1.0000 | 2.0000 | +1.0000 (worse) |" in text


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(-6, 0.6),) for _ in range(800)] + [(rng.gauss(-3, 0.5),) for _ in range(1200)] + [(None,)]
    fit = mixture.fit(spark.createDataFrame(rows, "log10_eta double")).collect()
    two = sorted((r.mean, r.weight) for r in fit if r.k == 2)
    assert two[0] == pytest.approx((-6, 0.4), abs=0.1) and two[1] == pytest.approx((-3, 0.6), abs=0.1)
    bic = {r.k: r.bic for r in fit}
    assert bic[2] < bic[1] and -5.2 < fit[1].log10_eta0 < -4
    assert mixture.crossover((0.5, -1, 1), (0.5, 1, 1)) == pytest.approx(0)


@pytest.fixture(scope="module")
def trained(spark):
    df, _ = catalog(spark, 500, 4)
    rows = cut(workflow.training_set(workflow.cluster(df)))
    return df, rows


@pytest.mark.parametrize("family", models.FAMILIES)
def test_families(spark, trained, family):
    _, rows = trained
    model = models.train(rows, family, models.Size(trees=5, depth=3, rounds=3, most_rounds=3))
    scored = models.score(model, rows).collect()
    assert len(scored) == rows.count()
    for r in scored:
        assert 0 <= r.p_within_10km <= r.p_within_25km + 1e-12 <= r.p_within_50km + 2e-12 <= r.p_any + 3e-12 <= 1 + 1e-9
        assert all(getattr(r, f"predicted_{t}") >= 0 for t in models.LOGGED)


def test_streamed_scores_and_rates(spark, trained, tmp_path):
    df, rows = trained
    model = models.train(rows, "forest", models.Size(trees=3, depth=3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(CSV.replace("2020", "2018"), encoding="utf-8")
    got = []
    query = scorer.score_stream(scorer.raw_stream(spark, str(tmp_path / "in")), lambda: df, model, lambda d, n: got.extend(d.collect()), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert len(got) == 5
    document = json.loads(got[0].document)
    assert set(document) == {"event_id", "probabilities", "zones", "regression"} and len(document["probabilities"]) == 5
    rates = scorer.hourly_rate(scorer.raw_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    rates.awaitTermination(120)
    assert spark.sql("SELECT sum(events) FROM rates").first()[0] == 5


def test_whole_workflow_and_files(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(CSV, encoding="utf-8")
    workflow.run(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"), cutoffs=(2.0,))
    assert spark.read.parquet(str(tmp_path / "out/clusters")).count() == 5
    rows = spark.read.parquet(str(tmp_path / "out/training/rows"))
    assert {*features.names(), *targets.names()} <= set(rows.columns) and rows.count() == 5
    assert sinks.read_manifest(spark, str(tmp_path / "out/training/features")) == features.names()
    text = spark.read.csv(str(tmp_path / "out/links_mc_2.0/links"), header=True)
    assert text.where("parent_id IS NULL").count() == 1 and text.count() == 4


def test_one_event_of_a_sample(spark):
    events = spark.range(9).selectExpr("id AS event_id", "id * 1000 AS sort_time")
    assert [r.event_id for r in sampling.chronological_sample(events, 1).collect()] == [0]


@pytest.mark.parametrize("family", ("gbt", "logit", "oblivious"))
def test_models_are_loaded_as_they_were_saved(spark, tmp_path, family):
    """Skipped targets stay skipped, and are answered by nulls."""
    names = ["magnitude", "depth_km", "parent_magnitude"]
    rows = spark.range(80).selectExpr("id AS event_id", "id AS sort_time", "id % 7 / 2D AS magnitude", "id % 5 * 1D AS depth_km", "if(id % 3 = 0, null, id % 4 * 1D) AS parent_magnitude", f"cast(id % 2 AS int) AS {models.ZONE}",
                                      *(f"cast(id % 2 AS int) AS {t}" for t in models.CLASSES.values()), *(f"if(id % 2 = 1, id % 6 * 1D, null) AS {t}" for t in models.REGRESSION[:3]), f"cast(null AS double) AS {models.REGRESSION[3]}")
    made = models.train(rows, family, models.Size(trees=2, depth=2, rounds=2, most_rounds=2), names)
    made.save(str(tmp_path / family))
    found = models.Model.load(str(tmp_path / family))
    scored = [models.score(m, rows).select("event_id", *models.CLASSES, *(f"predicted_{t}" for t in models.REGRESSION)).orderBy("event_id").collect() for m in (made, found)]
    assert scored[0] == scored[1] and scored[0][0][f"predicted_{models.REGRESSION[3]}"] is None
    assert len(models.importance(found, names)) == (3 if family in models.STOPPED else 4) and models.as_json(models.score(found, rows)).count() == 80
    empty = models.Model(family, made.prepare)
    assert models.score(empty, rows).where("p_any IS NULL").count() == 80 and models.score_table(models.score(empty, rows), family)[0].count() == 0


def test_smoothing_reflects_at_the_ends(spark):
    import numpy as np

    kernel = np.exp(-0.5 * (np.arange(-5, 6) / 1.2) ** 2)
    for counts in ([4, 0, 1, 7, 2, 9, 1, 1, 3], [5, 2], [6]):
        rows = [(0.05 + i / 10,) for i, n in enumerate(counts) for _ in range(n)]
        got = {r.bin: r.smoothed for r in sampling.smoothed_histogram(spark.createDataFrame(rows, "m double"), "m", 0.1).collect()}
        want = np.convolve(np.pad(np.array(counts, float), 5, mode="symmetric"), kernel / kernel.sum(), mode="valid")
        assert [got[i] for i in range(len(counts))] == pytest.approx(list(want), abs=1e-6)
    assert sampling.smoothed_histogram(spark.createDataFrame([], "m double"), "m", 0.1).count() == 0


def test_expectation_maximisation(spark):
    rng = random.Random(6)
    rows = [(rng.gauss(-7, 0.6),) for _ in range(600)] + [(rng.gauss(-4, 0.8),) for _ in range(1400)] + [(None,)] * 5
    low, high = mixture.expectation_maximisation(spark.createDataFrame(rows, "log10_eta double"), rounds=60).orderBy("component").collect()
    assert (low.weight, low.mean, low.sigma) == pytest.approx((0.3, -7, 0.6), abs=0.08)
    assert (high.weight, high.mean, high.sigma) == pytest.approx((0.7, -4, 0.8), abs=0.08)
    assert low.log10_eta0 == high.log10_eta0 == pytest.approx(mixture.crossover((low.weight, low.mean, low.sigma), (high.weight, high.mean, high.sigma)))
    assert low.bic > low.aic
    for none in ([], [(None,)], [(-5.0,)] * 9):
        assert mixture.expectation_maximisation(spark.createDataFrame(none, "log10_eta double")).count() == 0


def test_tables_are_reused_and_deleted(spark, tmp_path):
    from quakeloom import session

    spark.range(5).write.parquet(f"{tmp_path}/a")
    source, made = spark.read.parquet(f"{tmp_path}/a"), []

    def make():
        made.append(1)
        return source.selectExpr("id * 2 AS id")

    assert session.reused("twice", source, make).count() == session.reused("twice", source, make).count() == 5 and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/a")
    source = spark.read.parquet(f"{tmp_path}/a")
    kept = session.reused("twice", source, make)
    assert kept.count() == 7 and len(made) == 2
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    session.drop_cuts(spark)
    assert not os.path.exists(path)
    assert session.reused("twice", source, make).count() == 7 and len(made) == 3


def test_few_pairs_are_left_to_sort(spark):
    """Of the pairs that reach the sorted aggregate, each event has a few only, whatever the number of events."""
    from quakeloom.operators import neighbors
    from quakeloom.params import DEFAULT

    for n in (2000, 4000):
        at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000.0
        events = spark.range(n).select(
            F.col("id").alias("event_id"), (at(1) * 3e8).cast("long").alias("sort_time"), (30 + 6 * at(2)).alias("latitude"), (130 + 6 * at(3)).alias("longitude"),
            F.lit(10.0).alias("depth_km"), F.round(1 - F.log10(1 - at(4)), 1).alias("magnitude"),
        )
        left = [pairs.withColumn("eta", neighbors._eta(DEFAULT)).where("eta <= eta_limit").count() for pairs in neighbors._search(events, [None], DEFAULT)]
        assert len(left) == 2 and n * 0.9 < sum(left) < 4 * n


def test_a_cut_leaves_no_shuffle_files(spark):
    import glob
    import time

    files = lambda: len(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    before = files()
    written = cut(spark.range(10_000, numPartitions=16).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and written.agg(F.sum("n")).first()[0] == 10_000


def test_nearest_recent_is_that_of_all_pairs(spark):
    """Radius by radius, over dense and sparse places, high latitudes and equal distances."""
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    wide = F.when(F.col("id") % 3 == 0, 0.05).when(F.col("id") % 3 == 1, 1.0).otherwise(8.0)
    north = F.when(F.col("id") % 7 == 0, 80.0).otherwise(20.0)
    events = cut(spark.range(3000).select(
        F.col("id").alias("event_id"), (at(1) * 2e7).cast("long").alias("sort_time"), F.round(north + wide * at(2), 2).alias("latitude"), F.round(100 + wide * at(3), 2).alias("longitude"),
        F.lit(5.0).alias("depth_km"), (1 + 3 * at(4)).alias("magnitude"),
    ))
    for serving in (False, True):
        pairs = range_join.near_past(events.select("event_id", "sort_time", "latitude", "longitude"), events, 100, 30 * 86400, serving)
        first = pairs.groupBy("event_id").agg(F.min(F.struct("km", "p_sort_time", "p_event_id", "p_magnitude", (F.col("sort_time") - F.col("p_sort_time")).alias("age"))).alias("n"))
        plain = events.select("event_id").join(first, "event_id", "left").select("event_id", F.col("n.km").alias("distance_km"), F.col("n.p_magnitude").alias("magnitude"), (F.col("n.age") / 86400).alias("age_days"))
        mine = features.nearest_recent(events, events, serving)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, mine.collect()))
        assert mine.where("distance_km > 25").count() > 10 and mine.where("distance_km < 1").count() > 10
    plan = features.local_counts(events, events)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("split", [False, True])
def test_local_counts_are_those_of_all_pairs(spark, monkeypatch, split):
    """Dense and sparse places, copies, equal times, high latitudes, the date line, unknown magnitudes; tiles whole and split."""
    monkeypatch.setattr(disc_sums, "FEW_PAIRS", 50)
    monkeypatch.setattr(disc_sums, "PAIRS_AT_ONCE", 70)
    if split:
        monkeypatch.setattr(disc_sums, "TILE_EVENTS", 150)
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    wide = F.when(F.col("id") % 3 == 0, 0.05).when(F.col("id") % 3 == 1, 1.0).otherwise(6.0)
    north = F.when(F.col("id") % 7 == 0, 83.0).when(F.col("id") % 7 == 1, -1.0).otherwise(20.0)
    east = F.when(F.col("id") % 5 == 0, 179.5).when(F.col("id") % 5 == 1, -179.9).otherwise(100.0)
    events = cut(spark.range(3000).select(
        F.col("id").alias("event_id"), (F.floor(at(1) * 300) * 86400).alias("sort_time"), F.round(north + wide * at(2), 2).alias("latitude"), F.round(east + wide * at(3), 2).alias("longitude"),
        F.lit(5.0).alias("depth_km"), F.when(F.col("id") % 11 > 0, F.round(1 + 3 * at(4), 1)).alias("magnitude"),
    ))
    for serving in (False, True):
        pairs = range_join.near_past(events.select("event_id", "sort_time", "latitude", "longitude"), events, 100, 30 * 86400, serving)
        sums = []
        for r in (10, 25, 50, 100):
            for d in (1, 7, 30):
                inside = (F.col("km") <= r) & (F.col("p_sort_time") >= F.col("sort_time") - d * 86400)
                sums += [F.count_if(inside), F.max(F.when(inside, F.col("p_magnitude"))), F.log10(F.sum(F.when(inside, F.pow(F.lit(10.0), F.col("p_magnitude") * 1.5))))]
        plain = events.select("event_id").join(pairs.groupBy("event_id").agg(*sums), "event_id", "left").fillna(0).collect()
        mine = {r.event_id: list(r)[1:] for r in features.local_counts(events, events, serving=serving).collect()}
        names = [f"local_{what}_{r}km_past_{d}d" for r in (10, 25, 50, 100) for d in (1, 7, 30) for what in ("events", "max_mag", "log10_energy")]
        assert features.local_counts(events, events).columns[1:] == names
        assert len(mine) == len(plain) == 3000 and sum(r[34] for r in plain) > 10_000
        assert all(mine[r.event_id] == pytest.approx(list(r)[1:], abs=1e-9) for r in plain)
        long = range_join.near_past(events.select("event_id", "sort_time", "latitude", "longitude"), events, 50, int(1095.75 * 86400), serving)
        seen = {r.event_id: (r.n, r.mean) for r in long.groupBy("event_id").agg(F.count("*").alias("n"), F.avg("p_magnitude").alias("mean")).collect()}
        for r in features.local_b_value(events, events, serving=serving).collect():
            n, mean = seen.get(r.event_id, (0, None))
            b = min(3.0, max(0.3, 0.4342944819 / (mean - 1))) if n >= 5 and mean and mean > 1 else 1.0
            assert r.local_b_value_50km_3y == pytest.approx(b, abs=1e-9)


def test_pairs_looked_at_one_by_one_grow_slower_than_all_pairs():
    rng = np.random.default_rng(5)
    left = []
    for n in (10_000, 40_000):
        p = {"event_id": np.arange(n), "sort_time": np.sort(rng.integers(0, 30 * 86400, n)), "latitude": rng.uniform(10, 11, n), "longitude": rng.uniform(120, 121, n)}
        p |= {"magnitude": rng.uniform(1, 4, n), "half": np.full(n, 100 / 111.32) / np.cos(np.radians(p["latitude"]))}
        bounds = disc_sums._bounds(p, p, [30 * 86400], False)
        at = disc_sums._unit(p["latitude"], p["longitude"])
        chords = 2 * np.sin(np.array([10.0, 25.0, 50.0, 100.0]) / (2 * 6371.0088))
        found = [(asked, some) for asked, some, edge in disc_sums._halves(p, p, at, at, bounds, chords, 100 / 111.32) if edge]
        left.append(sum(int(np.diff(np.searchsorted(some, bounds[asked]), axis=1).sum()) for asked, some in found))
        assert left[-1] < 0.5 * n * (n - 1) / 2
    assert left[1] < 10 * left[0]  # all pairs: 16 times


def test_no_pair_of_the_search_for_parents_is_a_row(spark):
    """What reaches the aggregate of the best pairs is a few rows an event, also at one dense place; and each is the best of all pairs."""
    from quakeloom.operators import nearest_tiles, neighbors
    from quakeloom.params import DEFAULT

    rng = np.random.default_rng(5)
    for n in (3000, 6000):
        at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000.0
        place = lambda k, middle: F.when(F.col("id") % 3 > 0, middle + 0.02 * at(k)).otherwise(middle + 6 * at(k))
        events = spark.range(n).select(
            F.col("id").alias("event_id"), (at(1) * 3e8).cast("long").alias("sort_time"), place(2, 30.0).alias("latitude"), place(3, 130.0).alias("longitude"),
            F.lit(10.0).alias("depth_km"), F.round(1 - F.log10(1 - at(4)), 1).alias("magnitude"),
        )
        assert 0.9 * n < sum(pairs.count() for pairs in neighbors._search(events, [None], DEFAULT)) < 4 * n

    # poles, the date line, repeated places and times
    n = 400
    make = lambda: {"t": rng.integers(0, 2000, n) * 60, "lat": np.radians(np.round(rng.choice([-90.0, 89.99, 0.0, 10.0], n) + rng.random(n) * 0.01, 3)), "lon": np.radians(np.round(rng.choice([-180.0, 179.99, 0.0], n) + rng.random(n) * 0.01, 3)), "mag": np.round(1 + rng.exponential(1, n), 1)}
    q, p = make(), make()
    p |= {c: np.concatenate([p[c][:300], q[c][:100]]) for c in ("lat", "lon")}
    up, across = np.sin((q["lat"][:, None] - p["lat"]) / 2), np.sin((q["lon"][:, None] - p["lon"]) / 2)
    a = up * up + np.cos(q["lat"])[:, None] * np.cos(p["lat"]) * across * across
    seconds = (q["t"][:, None] - p["t"]).astype(float)
    with np.errstate(invalid="ignore"):
        values = seconds * (2 * nearest_tiles.EARTH_KM * np.arcsin(np.minimum(np.sqrt(a), 1))) ** 1.6 * 10.0 ** -p["mag"]
    values[(seconds <= 0) | (a == 0)] = np.inf
    i, j, least = nearest_tiles.nearest(q, p, 1.6, 1.0, np.full(n, np.inf))
    some = np.isfinite(values.min(axis=1))
    assert np.allclose(least[some], values.min(axis=1)[some], rtol=1e-7) and not np.isfinite(least[~some]).any()
    assert set(i) == set(np.flatnonzero(some)) and (values[i, j] <= least[i] * (1 + 1e-6)).all()


def test_no_pair_of_the_search_for_recent_events_is_a_row(spark):
    """The pairs of a dense place meet in a tile: no join, whose rows would be pairs, is left but those that deal events out and put answers beside events."""
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.col("id").alias("sort_time"), F.lit(30.0).alias("latitude"), (100 + F.col("id") * 1e-3).alias("longitude"), F.lit(1.0).alias("magnitude"))
    found = features.nearest_recent(events, events)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "p_sort_time" not in " ".join(line for line in plan.splitlines() if "Join" in line)
    assert found.where("round(distance_km / 0.0963, 1) = 1 AND age_days * 86400 = 1").count() == 1999
