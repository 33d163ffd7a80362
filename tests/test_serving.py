"""Serving parents of events that are no part of the history, by brute force; and all events are answered."""

import math
import random
from dataclasses import replace

from pyspark.sql import functions as F

from quakeloom import registry
from quakeloom.operators import neighbors
from quakeloom.params import DEFAULT as P
from quakeloom.params import EARTH_KM, YEAR_SECONDS


def test_parents_of_unknown_events(spark):
    rng = random.Random(4)
    event = lambda i: (i, rng.randrange(10**8), rng.uniform(-60, 60) if i % 3 else 10 + rng.random() / 5, rng.uniform(-180, 180) if i % 3 else 20 + rng.random() / 5, P.m_c - 0.5 + rng.expovariate(2))
    history, queries = [event(i) for i in range(700)], [event(1000 + i) for i in range(100)]
    queries += [(2000, -5, 1.0, 1.0, 3.0), (2001, 10**9, *history[0][2:])]
    make = lambda rows: spark.createDataFrame(rows, "event_id long, sort_time long, latitude double, longitude double, magnitude double")

    def eta(q, h):
        up, across = (math.sin(math.radians(q[k] - h[k]) / 2) for k in (2, 3))
        km = 2 * EARTH_KM * math.asin(math.sqrt(up * up + math.cos(math.radians(q[2])) * math.cos(math.radians(h[2])) * across * across))
        return math.log10((q[1] - h[1]) / YEAR_SECONDS) + P.d_f * math.log10(km) - P.b * h[4] if km > 0 else math.inf

    expected = {q[0]: min((eta(q, h), h[0]) for h in history if h[4] >= P.m_c and h[1] < q[1])[1] for q in queries if any(h[4] >= P.m_c and h[1] < q[1] for h in history)}
    got = {r.event_id: r.parent_id for r in neighbors.parents_of_queries(make(queries), make(history)).collect()}
    assert got == expected and 2000 not in got and 2001 in got


def test_all_events_are_registered():
    assert {"serving_parents_all", "global_activity_serving_all"} <= set(registry.queries()) & set(registry.oracle_sql())


def _catalog(rng, n):
    """Uniform events and dense clusters, with repeated places, times and magnitudes."""
    rows = []
    for i in range(n):
        near = i % 4 == 0
        lat, lon = (10 + rng.random() / 20, 179.99 + rng.random() / 50) if near else (rng.uniform(-89, 89), rng.uniform(-180, 180))
        rows.append((i, rng.randrange(10**8) // 60 * 60, round(lat, 3), round(lon - 360 if lon > 180 else lon, 3), round(1 + rng.expovariate(1.5), 1)))
    return rows


def _brute(rows, m_c):
    """parent and eta of each event of magnitude m_c or more."""
    kept, out = [r for r in rows if r[4] >= m_c], {}
    for q in kept:
        best = None
        for h in kept:
            if h[1] < q[1]:
                up, across = (math.sin(math.radians(q[k] - h[k]) / 2) for k in (2, 3))
                km = 2 * EARTH_KM * math.asin(min(1, math.sqrt(up * up + math.cos(math.radians(q[2])) * math.cos(math.radians(h[2])) * across * across)))
                if km > 0:
                    eta = math.log10((q[1] - h[1]) / YEAR_SECONDS) + P.d_f * math.log10(km) - P.b * h[4]
                    best = min(best or (math.inf,), (eta, h[1], h[0]))
        out[q[0]] = best
    return out


SCHEMA = "event_id long, sort_time long, latitude double, longitude double, magnitude double"


def test_parents_by_cutoff(spark):
    rows, cutoffs = _catalog(random.Random(8), 900), [1.0, 1.7, 2.5, 4.0, 9.0]
    found = neighbors.parents_by_cutoff(spark.createDataFrame(rows, SCHEMA), cutoffs).collect()
    expected = {(m, i): best for m in cutoffs for i, best in _brute(rows, m).items()}
    assert {(r.m_c, r.event_id) for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        best = expected[r.m_c, r.event_id]
        assert (best is None) == (r.parent_id is None)
        assert best is None or abs(r.log10_eta - best[0]) < 1e-9
    assert any(r.parent_id is None for r in found)


def test_cutoffs_agree_with_single_searches(spark):
    df = spark.createDataFrame(_catalog(random.Random(9), 700), SCHEMA).selectExpr("*", "1D AS depth_km")
    by_cutoff = neighbors.with_parents_by_cutoff(df, [1.0, 2.5])
    for m_c in (1.0, 2.5):
        single = neighbors.with_parents(df, replace(P, m_c=m_c))
        some = by_cutoff.where(f"m_c = {m_c}").select(single.columns)
        assert some.exceptAll(single).count() == 0 and single.exceptAll(some).count() == 0


def test_pairs_grow_with_the_events(spark):
    """Twice the events in the same region and span cost at most 2.5 times the pairs."""
    def catalog(n):
        i, u = F.col("id"), lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**6)) / 1e6
        return spark.range(n).select(i.alias("event_id"), (u(1) * 250_000_000).cast("long").alias("sort_time"), (5 + 15 * u(2)).alias("latitude"), (118 + 10 * u(3)).alias("longitude"), (1 - F.log10(1 - u(4) * 0.99999)).alias("magnitude"))

    small, large = (neighbors.candidate_pairs(catalog(n)).count() for n in (6000, 12000))
    assert 0 < small < 6000 * 6000 / 2 / 10 and large <= 2.5 * small, (small, large)
