"""Forecast targets: what follows each event within its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.functions import geo

ZONES_KM = (10, 25, 50)


def names(hours: int = 24) -> list[str]:
    return [
        f"aftershock_spatial_zone_{hours}h", f"aftershock_{hours}h", *(f"aftershock_within_{r}km_{hours}h" for r in ZONES_KM), f"aftershock_beyond_50km_{hours}h",
        *(f"{s}_aftershock_distance_km_{hours}h" for s in ("nearest", "median", "p90")), f"max_aftershock_mag_{hours}h",
    ]


def build(clustered: DataFrame, hours: int = 24) -> DataFrame:
    """event_id and the ten targets over (t, t + hours]. Distances and magnitude are null without aftershocks."""
    span = hours * 3600
    after = clustered.where("event_role = 'aftershock'").select("cluster_id", *(F.col(c).alias(f"a_{c}") for c in ("sort_time", "latitude", "longitude", "magnitude")))
    # an event looks into the two buckets that its window touches, so that large families are spread
    events = clustered.select("event_id", "cluster_id", "sort_time", "latitude", "longitude").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("sort_time") / span), F.floor(F.col("sort_time") / span) + 1)))
    after = after.withColumn("_bucket", F.floor(F.col("a_sort_time") / span))
    inside = (F.col("a_sort_time") > F.col("sort_time")) & (F.col("a_sort_time") <= F.col("sort_time") + span)
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("a_latitude"), F.col("a_longitude"))
    pairs = events.join(after, ["cluster_id", "_bucket"]).where(inside).select("event_id", km.alias("km"), "a_magnitude")
    seen = pairs.groupBy("event_id").agg(F.min("km").alias("nearest"), F.percentile("km", 0.5).alias("median"), F.percentile("km", 0.9).alias("p90"), F.max("a_magnitude").alias("largest"))
    out = clustered.select("event_id").join(seen, "event_id", "left")
    near = F.col("nearest")
    zone = F.when(near.isNull(), 0).when(near <= 10, 1).when(near <= 25, 2).when(near <= 50, 3).otherwise(4)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return out.select("event_id", zone, flag(near.isNotNull()), *(flag(near <= r) for r in ZONES_KM), flag(near > 50), near, "median", "p90", "largest").toDF("event_id", *names(hours))


def extended(clustered: DataFrame) -> DataFrame:
    """event_id, aftershocks within 48 and 72 hours and 7 days, whether a larger one or one of M 5 follows,
    and the seconds to the next."""
    week = 7 * 86400
    after = clustered.where("event_role = 'aftershock'").select("cluster_id", F.col("sort_time").alias("a_time"), F.col("magnitude").alias("a_magnitude"), F.floor(F.col("sort_time") / week).alias("_bucket"))
    events = clustered.select("event_id", "cluster_id", "sort_time", "magnitude")
    asked = events.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("sort_time") / week), F.floor(F.col("sort_time") / week) + 1)))
    wait = F.col("a_time") - F.col("sort_time")
    seen = asked.join(after, ["cluster_id", "_bucket"]).where((wait > 0) & (wait <= week)).groupBy("event_id").agg(
        F.count_if(wait <= 48 * 3600).alias("aftershocks_48h"), F.count_if(wait <= 72 * 3600).alias("aftershocks_72h"), F.count("*").alias("aftershocks_7d"),
        F.max((F.col("a_magnitude") > F.col("magnitude")).cast("int")).alias("larger_7d"), F.max((F.col("a_magnitude") >= 5).cast("int")).alias("m5_7d"), F.min(wait).alias("seconds_to_next"),
    )
    return events.select("event_id").join(seen, "event_id", "left").fillna(0, ["aftershocks_48h", "aftershocks_72h", "aftershocks_7d", "larger_7d", "m5_7d"])
