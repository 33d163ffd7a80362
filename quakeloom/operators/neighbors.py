"""Nearest-neighbour parents: of all earlier events, the one with the least eta.

Parents are looked for in tiles of time and of space (operators/nearest_tiles.py). A tile answers the pairs that are as good as the best up to its
rounding, one an event as a rule; their eta, and the order of equal ones, are Spark's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.operators import nearest_tiles
from quakeloom.params import DEFAULT, EARTH_KM, YEAR_SECONDS, Params
from quakeloom.session import cut

#: More than any rounding of a bound, in log10 units.
SLACK = 1e-7


def _eta(p: Params) -> Column:
    """log10 eta of a pair with prepared angles; null unless both gaps are positive."""
    up, across = F.sin((F.col("p_lat") - F.col("lat")) / 2.0), F.sin((F.col("p_lon") - F.col("lon")) / 2.0)
    a = up * up + F.cos("lat") * F.cos("p_lat") * across * across
    km = F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    return geo.log10_eta(F.col("t") - F.col("p_t"), km, F.col("p_mag"), p)


def _prepared(df: DataFrame, role: int) -> DataFrame:
    """Events whose time and place are known; earlier ones need a magnitude, too."""
    known = ["sort_time", "latitude", "longitude", *(["magnitude"] if role & 1 else [])]
    there = reduce(Column.__and__, (F.col(c).isNotNull() & (~F.isnan(c) if c != "sort_time" else F.lit(True)) for c in known))
    mag = F.coalesce(F.col("magnitude").cast("double"), F.lit(float("nan")))
    return df.where(there).select(
        F.col("event_id").cast("long").alias("event_id"), F.col("sort_time").cast("long").alias("t"), mag.alias("mag"),
        F.radians("latitude").alias("lat"), F.radians("longitude").alias("lon"), F.lit(role).alias("role"),
    )


def _rows(catalog: DataFrame, history: DataFrame | None) -> DataFrame:
    """The events that ask and the earlier ones, written."""
    return cut(_prepared(catalog, 3) if history is None else _prepared(catalog, 2).unionByName(_prepared(history, 1)))


def _search(catalog: DataFrame, cutoffs: list[float | None], p: Params, history: DataFrame | None = None) -> list[DataFrame]:
    """Pairs of which one is each event's best by layer (place in `cutoffs`), with eta_limit, a bound of the eta that can be best: those of slabs of time, then
    those of cubes of space."""
    limit = F.log10(F.col("value") / YEAR_SECONDS) + SLACK
    return [pairs.withColumn("eta_limit", limit) for pairs in nearest_tiles.search(_rows(catalog, history), cutoffs, p)]


def _found(catalog: DataFrame, cutoffs: list[float | None], p: Params, history: DataFrame | None = None) -> DataFrame:
    """event_id, layer and b: eta, p_t and p_event_id of the least eta among parents of the layer's magnitude or more."""
    every = reduce(DataFrame.unionByName, _search(catalog, cutoffs, p, history))
    better = every.withColumn("eta", _eta(p)).where("eta IS NOT NULL").select("event_id", "layer", F.struct("eta", "p_t", "p_event_id").alias("b"))
    return better.groupBy("event_id", "layer").agg(F.min("b").alias("b"))


def parents(catalog: DataFrame, p: Params = DEFAULT, history: DataFrame | None = None) -> DataFrame:
    """event_id and parent_id of every event with an earlier event (of `history`, if given) at another place."""
    return _found(catalog, [None], p, history).select("event_id", F.col("b.p_event_id").alias("parent_id"))


def parents_by_cutoff(catalog: DataFrame, cutoffs: list[float], p: Params = DEFAULT) -> DataFrame:
    """m_c, event_id, parent_id and log10_eta of each event of magnitude m_c or more among those events, for all cutoffs
    from one search; without an earlier event parent_id and log10_eta are null."""
    steps = sorted(set(cutoffs))
    kept = catalog.where(F.col("magnitude") >= steps[0])
    found = _found(kept, list(steps), p)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("layer"), F.lit(float(m)).alias("m_c")) for i, m in enumerate(steps)))).alias("r")
    rows = kept.select("event_id", "magnitude", each).where(F.col("magnitude") >= F.col("r.m_c")).select("event_id", "r.*").join(found, ["event_id", "layer"], "left")
    return rows.select("m_c", "event_id", F.col("b.p_event_id").alias("parent_id"), F.col("b.eta").alias("log10_eta"))


def candidate_pairs(catalog: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The pairs that `parents` compares, to count them."""
    return nearest_tiles.compared(_rows(catalog, None), [None], p)


def _attributes(kept: DataFrame, links: DataFrame, p: Params, *more: str) -> DataFrame:
    """Events of `kept` with what their parents say. links: event_id, parent_id and the columns in `more` of each event that is asked for."""
    of = kept.select(F.col("event_id").alias("parent_id"), *(F.col(c).alias(f"p_{c}") for c in ("sort_time", "latitude", "longitude", "depth_km", "magnitude")))
    seconds = F.col("sort_time") - F.col("p_sort_time")
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("p_latitude"), F.col("p_longitude"))
    eta = geo.log10_eta(F.col("gap_seconds"), F.col("distance_km"), F.col("parent_magnitude"), p)
    out = links.join(of, "parent_id", "left").select(
        *more, *kept.columns, "parent_id", seconds.alias("gap_seconds"), km.alias("distance_km"), F.col("p_magnitude").alias("parent_magnitude"), F.col("p_depth_km").alias("parent_depth_km")
    )
    out = out.withColumn("log10_eta", eta)
    return out.withColumn("is_strong", F.coalesce(F.col("log10_eta") < p.log10_eta0, F.lit(False)))


def with_parents(catalog: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Events of magnitude m_c or more with parent_id, gap_seconds, distance_km, parent_magnitude,
    parent_depth_km, log10_eta, is_strong. All null (and not strong) without an earlier event."""
    kept = catalog.where(F.col("magnitude") >= p.m_c)
    return _attributes(kept, kept.join(parents(kept, p), "event_id", "left"), p)


def with_parents_by_cutoff(catalog: DataFrame, cutoffs: list[float], p: Params = DEFAULT) -> DataFrame:
    """What `with_parents` says for each m_c of `cutoffs`, keyed by m_c and event_id, from one search."""
    kept = catalog.where(F.col("magnitude") >= min(cutoffs))
    found = parents_by_cutoff(kept, cutoffs, p).drop("log10_eta")
    return _attributes(kept, found.join(kept, "event_id"), p, "m_c")


def parents_of_queries(queries: DataFrame, history: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Serving form: event_id and parent_id of query events among the strictly earlier history."""
    return parents(queries, p, history.where(F.col("magnitude") >= p.m_c))


def eta_histogram(linked: DataFrame, width: float = 0.1) -> DataFrame:
    """bin_lower, bin_upper, event_count of log10 eta; events without a parent have none."""
    if width <= 0:
        raise ValueError("the bin width must be positive")
    index = geo.bin_index(F.col("log10_eta"), width)
    counted = linked.where("log10_eta IS NOT NULL").groupBy(index.alias("i")).agg(F.count("*").alias("event_count"))
    return counted.select(geo.bin_lower(F.col("i"), width).alias("bin_lower"), geo.bin_lower(F.col("i") + 1, width).alias("bin_upper"), "event_count")


def threshold_links(linked: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold of log10 eta: strong and weak events and their percentages."""
    counts = linked.agg(F.count("*").alias("total"), *(F.count_if(F.col("log10_eta") < t).alias(f"n{i}") for i, t in enumerate(thresholds)))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("strong_links")) for i, t in enumerate(thresholds))))
    rows = counts.select("total", each.alias("x")).select("total", "x.*").withColumn("weak_links", F.col("total") - F.col("strong_links"))
    percent = lambda c: geo.rounded(F.col(c) * 100.0 / F.col("total"))
    return rows.select("threshold", "strong_links", "weak_links", percent("strong_links").alias("strong_percent"), percent("weak_links").alias("weak_percent"))
