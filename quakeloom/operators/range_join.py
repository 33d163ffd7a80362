"""Joins of events with others near in space and time, by equal cells and an exact residual.

Latitude rows are as high as the radius. In each row the longitude cells are as wide as the widest
search box that can reach it. An event that is searched for looks into the cells that its box touches,
in its own and the previous time bucket; each other event lies in one cell of one bucket, so that a
pair meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.params import DEGREE_KM

_HISTORY = ("event_id", "sort_time", "latitude", "longitude", "magnitude", "depth_km")


def scale(latitude: Column) -> Column:
    """Shrinking of longitude degrees, with the floor that the search box has."""
    return F.greatest(F.cos(F.radians(latitude)), F.lit(0.1))


def _width(row: Column, height: float, radius_km: float) -> Column:
    far = F.least(F.greatest(F.abs((row - 1) * height), F.abs((row + 2) * height)), F.lit(90.0))
    return F.lit(radius_km / DEGREE_KM) / scale(far)


def near_past(queries: DataFrame, history: DataFrame, radius_km: float, window_seconds: int, serving: bool = False) -> DataFrame:
    """Pairs (columns of `queries`, p_ columns of earlier events, km) within radius and window.

    Earlier: before in the order of (sort_time, event_id); when serving, strictly earlier in time. The
    search box doesn't wrap at 180 degrees.
    """
    height = radius_km / DEGREE_KM
    row, bucket = F.floor(F.col("latitude") / height), F.floor(F.col("sort_time") / window_seconds)
    half = F.lit(height) / scale(F.col("latitude"))
    seeking = queries.withColumn("_half", half).withColumn("_row", F.explode(F.sequence(row - 1, row + 1)))
    width = _width(F.col("_row"), height, radius_km)
    cells = F.sequence(F.floor((F.col("longitude") - F.col("_half")) / width), F.floor((F.col("longitude") + F.col("_half")) / width))
    seeking = seeking.withColumn("_cell", F.explode(cells)).withColumn("_bucket", F.explode(F.sequence(bucket - 1, bucket)))
    past = history.select(*(F.col(c).alias(f"p_{c}") for c in _HISTORY if c in history.columns)).withColumns(
        {"_row": F.floor(F.col("p_latitude") / height), "_bucket": F.floor(F.col("p_sort_time") / window_seconds)}
    )
    past = past.withColumn("_cell", F.floor(F.col("p_longitude") / _width(F.col("_row"), height, radius_km)))

    earlier = F.col("p_sort_time") < F.col("sort_time")
    if not serving:
        earlier = earlier | ((F.col("p_sort_time") == F.col("sort_time")) & (F.col("p_event_id") < F.col("event_id")))
    recent = F.col("p_sort_time") >= F.col("sort_time") - window_seconds
    box = (F.abs(F.col("p_latitude") - F.col("latitude")) <= height) & (F.abs(F.col("p_longitude") - F.col("longitude")) <= F.col("_half"))
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("p_latitude"), F.col("p_longitude"))
    pairs = seeking.join(past, ["_row", "_cell", "_bucket"]).where(earlier & recent & box).withColumn("km", km)
    return pairs.where(F.col("km") <= radius_km).drop("_row", "_cell", "_bucket", "_half")
