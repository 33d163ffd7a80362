"""Every query with SQL against DuckDB, on the smallest tables, and invariants between queries."""

import glob
import os

import duckdb
import pytest

from quakeloom import registry

DATA = os.environ.get("QUAKELOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def same(df, found):
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    ours = sorted(repr([r[c] for c in columns]) for r in df.collect())
    at = [found.columns.index(c) for c in columns]
    assert ours == sorted(repr([r[i] for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(registry.queries()[name](spark, DATA), duck.sql(registry.oracle_sql()[name]))


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_forest_identities(spark):
    q = registry.queries()
    found = q["clustered_events"](spark, DATA).cache()
    strong = found.where("is_strong").count()
    assert found.select("cluster_id").distinct().count() == found.count() - strong
    assert found.where("event_role = 'mainshock'").count() == found.where("is_family_member").select("cluster_id").distinct().count()


def test_rescaled_parts_add_up(spark):
    q = registry.queries()
    t = q["rescaled_tr"](spark, DATA).join(q["nearest_parent"](spark, DATA), "event_id")
    assert t.where("abs(log10_t + log10_r - log10_eta) > 2e-6").count() == 0


def test_features_do_not_see_the_future(spark):
    from pyspark.sql import functions as F

    from quakeloom.functions import geo
    from quakeloom.operators import features, neighbors
    from quakeloom.sources.derived import catalog

    whole = catalog(spark, DATA).where("magnitude >= 1")
    cut = whole.approxQuantile("sort_time", [0.6], 0)[0]
    early = whole.where(f"sort_time <= {cut}")
    shown = lambda df: df.select(*(geo.rounded(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes))
    a = shown(features.build(neighbors.with_parents(whole)).where(f"sort_time <= {cut}"))
    b = shown(features.build(neighbors.with_parents(early)))
    assert len(features.names()) == 65
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_zones_are_nested(spark):
    t = registry.queries()["forecast_targets"](spark, DATA)
    assert t.where("aftershock_within_10km_24h > aftershock_within_25km_24h OR aftershock_within_25km_24h > aftershock_within_50km_24h OR aftershock_within_50km_24h > aftershock_24h").count() == 0


def test_cluster_roots_are_those_of_the_clusters(spark):
    q = registry.queries()
    roots, members = q["cluster_roots"](spark, DATA), q["clustered_events"](spark, DATA)
    both = roots.join(members, "event_id")
    assert both.count() == roots.count() == members.count() > 0
    assert both.select("root", "cluster_id").distinct().count() == both.select("root").distinct().count() == both.select("cluster_id").distinct().count()


def test_the_plan_of_the_training_set_holds_its_parts_as_tables(spark):
    """The driver's memory follows the plan: written parts are joined, no part is planned again."""
    from quakeloom.plans import feature_queries, model_queries

    plans = [model_queries.training_set(spark, DATA), feature_queries.clustered(spark, DATA)]
    assert [p._jdf.queryExecution().optimizedPlan().toString().count("Join ") < 8 for p in plans] == [True, True]
