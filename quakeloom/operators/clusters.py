"""Clusters: forests of strong links, their mainshocks and the roles of their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.functions.dates import parse_free
from quakeloom.functions.ordering import first_by, numbered
from quakeloom.operators.graph import roots
from quakeloom.session import cut

DAY = 86400
#: Columns that hold days after the mainshock.
DELAYS = ("delay_days", "time_to_mainshock_days", "time_since_mainshock_days")
#: Columns of the clustered table after those of the linked one.
LABELS = (
    "link_type", "cluster_id", "cluster_type", "cluster_size", "event_role", "is_single", "is_family_member",
    "mainshock_id", "mainshock_time", "mainshock_magnitude", "foreshock_count", "aftershock_count",
)


def cluster_roots(linked: DataFrame) -> DataFrame:
    """event_id and root of every event."""
    strong = linked.select("event_id", F.when(F.col("is_strong"), F.col("parent_id")).alias("up"))
    return roots(strong, "event_id", "up").select(F.col("node").alias("event_id"), "root")


def assign(linked: DataFrame) -> DataFrame:
    """`linked` with LABELS. linked: event_id, sort_time, magnitude, parent_id, is_strong and more.

    Clusters are numbered by their first member; the mainshock is the largest event, of equals the
    earliest; members before it are foreshocks, all others aftershocks.
    """
    rooted = linked.join(cluster_roots(linked), "event_id")
    head = F.max_by(F.struct("event_id", "sort_time", "magnitude"), F.struct("magnitude", -F.col("sort_time"), -F.col("event_id")))
    first = F.min(F.struct("sort_time", "event_id"))
    groups = rooted.groupBy("root").agg(head.alias("h"), first.alias("f"), F.count("*").alias("cluster_size"))
    groups = groups.select("root", "cluster_size", F.col("h.event_id").alias("main_id"), F.col("h.sort_time").alias("main_time"), F.col("h.magnitude").alias("main_magnitude"), F.col("f.sort_time").alias("_t"), F.col("f.event_id").alias("_e"))
    # a row per cluster, written once: the plan would hold it, and all below it, several times
    groups = cut(numbered(cut(groups), "_t", "_e", name="cluster_id").drop("_t", "_e"))
    role = (
        F.when(F.col("cluster_size") == 1, "single")
        .when(F.col("event_id") == F.col("main_id"), "mainshock")
        .when(F.col("sort_time") < F.col("main_time"), "foreshock")
        .otherwise("aftershock")
    )
    named = rooted.join(groups, "root").withColumn("event_role", role)
    counts = named.groupBy("cluster_id").agg(F.count_if(F.col("event_role") == "foreshock").alias("foreshock_count"), F.count_if(F.col("event_role") == "aftershock").alias("aftershock_count"))
    family = F.col("cluster_size") > 1
    labels = {
        "link_type": F.when(F.col("is_strong"), "strong").otherwise("weak"),
        "cluster_type": F.when(family, "family").otherwise("single"),
        "is_single": ~family,
        "is_family_member": family,
        "mainshock_id": F.when(family, F.col("main_id")),
        "mainshock_time": F.when(family, F.col("main_time")),
        "mainshock_magnitude": F.when(family, F.col("main_magnitude")),
    }
    return named.join(counts, "cluster_id").withColumns(labels).select(*linked.columns, *LABELS)


def family_summary(clustered: DataFrame) -> DataFrame:
    """One row per family: size, counts, span of time, magnitude of the mainshock."""
    return clustered.where("is_family_member").groupBy("cluster_id").agg(
        F.count("*").alias("members"),
        F.max("foreshock_count").alias("foreshocks"),
        F.max("aftershock_count").alias("aftershocks"),
        F.max("mainshock_id").alias("mainshock_id"),
        F.max("mainshock_magnitude").alias("mainshock_magnitude"),
        geo.rounded((F.max("sort_time") - F.min("sort_time")) / DAY).alias("duration_days"),
    )


def largest_families(clustered: DataFrame, k: int = 10) -> DataFrame:
    return family_summary(clustered).orderBy(F.desc("members"), "cluster_id").limit(k)


def role_counts(clustered: DataFrame) -> DataFrame:
    """Events by role, link type and cluster type."""
    return clustered.groupBy("event_role", "link_type", "cluster_type").agg(F.count("*").alias("events"))


def role_mix(clustered: DataFrame) -> DataFrame:
    """Percent of each role per whole magnitude."""
    band = F.floor("magnitude").cast("long")
    roles = ("single", "mainshock", "foreshock", "aftershock")
    counted = clustered.groupBy(band.alias("magnitude_band")).agg(F.count("*").alias("events"), *(F.count_if(F.col("event_role") == r).alias(r) for r in roles))
    return counted.select("magnitude_band", "events", *(geo.rounded(F.col(r) * 100.0 / F.col("events")).alias(f"{r}_percent") for r in roles))


def delta_members(clustered: DataFrame, m_c: float, delta: float = 2.0) -> DataFrame:
    """Members within `delta` of mainshocks that are at least m_c + delta."""
    large = F.col("mainshock_magnitude") >= m_c + delta
    close = F.col("magnitude") >= F.col("mainshock_magnitude") - delta
    return clustered.where(F.col("is_family_member") & large & close)


def _moment(df: DataFrame, *names: str) -> Column | None:
    """Seconds since 1970 of the first of these columns that is there: numbers as they are, texts in any form that catalogs use."""
    for name in names:
        if name in df.columns:
            return parse_free(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name).cast("long")
    return None


def with_delay(clustered: DataFrame) -> DataFrame:
    """Aftershocks with delay_days after the mainshock, from the first source that is there: delay_days itself, a column
    of days of another name, the mainshock's time, or the time of the event that mainshock_id names.

    Unreadable days and times give null; an error if there is no source."""
    after = clustered.where("event_role = 'aftershock'")
    days = [c for c in DELAYS if c in clustered.columns]
    if days:
        return after.withColumn("delay_days", F.col(days[0]).try_cast("double"))
    own, main_time = _moment(clustered, "sort_time", "event_time", "origin_time"), _moment(clustered, "mainshock_time")
    if own is not None and main_time is not None:
        return after.withColumn("delay_days", (own - main_time) / DAY)
    named = [c for c in ("mainshock_id", "sequence_mainshock_event_id") if c in clustered.columns]
    if own is None or not named:
        raise ValueError("no delay: there are neither days nor times of mainshocks")
    main = clustered.select(F.col("event_id").alias(named[0]), own.alias("_main_time"))
    return after.join(main, named[0], "left").withColumn("delay_days", (own - F.col("_main_time")) / DAY).drop("_main_time")


def window_summary(delays: DataFrame) -> DataFrame:
    """Valid delays within a day, a week, and beyond; null and negative delays are invalid."""
    valid = F.col("delay_days") >= 0
    day, week = F.col("delay_days") <= 1, F.col("delay_days") <= 7
    counted = delays.agg(
        F.count("*").alias("events"), F.count_if(valid).alias("valid"),
        F.count_if(valid & day).alias("within_1d"), F.count_if(valid & ~day & week).alias("from_1d_to_7d"), F.count_if(valid & ~week).alias("after_7d"),
    )
    percent = lambda c: geo.rounded(F.col(c) * 100.0 / F.nullif(F.col("valid"), F.lit(0))).alias(f"{c}_percent")
    return counted.select("*", (F.col("events") - F.col("valid")).alias("invalid"), percent("within_1d"), percent("from_1d_to_7d"), percent("after_7d"))


def strongest_aftershocks(clustered: DataFrame) -> DataFrame:
    """The largest aftershock of each family, of equals the soonest."""
    return first_by(with_delay(clustered), ["cluster_id"], [F.desc("magnitude"), F.asc("delay_days"), F.asc("event_id")])
