"""Magnitude diagnostics of a catalog: bins, cutoffs, yearly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.functions import geo


def year_of(time: str = "sort_time"):
    return F.year(F.timestamp_seconds(time)).cast("long")


def magnitude_bins(catalog: DataFrame, width: float = 0.1) -> DataFrame:
    """bin_lower, bin_upper, event_count of bins that hold events."""
    if width <= 0:
        raise ValueError("the bin width must be positive")
    counted = catalog.groupBy(geo.bin_index(F.col("magnitude"), width).alias("i")).agg(F.count("*").alias("event_count"))
    return counted.select(geo.bin_lower(F.col("i"), width).alias("bin_lower"), geo.bin_lower(F.col("i") + 1, width).alias("bin_upper"), "event_count")


def cutoffs(catalog: DataFrame, step: int = 1) -> DataFrame:
    """Tenths of magnitude from the least to the largest event, as (tenths, cutoff)."""
    ends = catalog.agg(F.floor(F.min("magnitude") * 10 + 1e-9).alias("a"), F.floor(F.max("magnitude") * 10 + 1e-9).alias("b"))
    return ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("tenths")).withColumn("cutoff", F.col("tenths") / 10.0)


def cutoff_counts(catalog: DataFrame) -> DataFrame:
    """cutoff and the number of events of at least that magnitude, none left out.

    Events are counted per tenth first; the running sum is over the few tenths.
    """
    tenth = F.floor(F.col("magnitude") * 10 + 1e-9)
    counted = catalog.groupBy(tenth.alias("tenths")).agg(F.count("*").alias("n"))
    dense = cutoffs(catalog).join(counted, "tenths", "left").fillna(0, ["n"])
    return dense.select("cutoff", F.sum("n").over(Window.orderBy(F.desc("tenths"))).alias("event_count"))


def yearly_cutoff_counts(catalog: DataFrame) -> DataFrame:
    """year, cutoff, event_count for every year of the catalog and every cutoff, zeros included."""
    tenth = F.floor(F.col("magnitude") * 10 + 1e-9)
    counted = catalog.groupBy(year_of().alias("year"), tenth.alias("tenths")).agg(F.count("*").alias("n"))
    grid = counted.select("year").distinct().join(F.broadcast(cutoffs(catalog)))  # years by tenths of magnitude: a few hundred rows
    dense = grid.join(counted, ["year", "tenths"], "left").fillna(0, ["n"])
    return dense.select("year", "cutoff", F.sum("n").over(Window.partitionBy("year").orderBy(F.desc("tenths"))).alias("event_count"))


def yearly_share(catalog: DataFrame) -> DataFrame:
    """year, events, percent of all."""
    counted = catalog.groupBy(year_of().alias("year")).agg(F.count("*").alias("events"))
    return counted.select("year", "events", geo.rounded(F.col("events") * 100.0 / F.sum("events").over(Window.partitionBy())).alias("percent"))


def max_curvature(catalog: DataFrame, width: float = 0.1) -> DataFrame:
    """The fullest magnitude bin, of equals the lowest."""
    return magnitude_bins(catalog, width).orderBy(F.desc("event_count"), "bin_lower").limit(1)


def yearly_variation(catalog: DataFrame, cutoffs_: list[float], years: tuple[int, int]) -> DataFrame:
    """Per cutoff: events, and coefficient of variation of the yearly counts of these years."""
    span = range(years[0], years[1] + 1)
    counted = catalog.groupBy().agg(
        *(F.count_if((F.col("magnitude") >= c) & (year_of() == y)).alias(f"n_{i}_{y}") for i, c in enumerate(cutoffs_) for y in span),
        *(F.count_if(F.col("magnitude") >= c).alias(f"all_{i}") for i, c in enumerate(cutoffs_)),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"all_{i}").alias("events"), F.array(*(F.col(f"n_{i}_{y}") for y in span)).alias("ys")) for i, c in enumerate(cutoffs_))))
    long = counted.select(rows.alias("x")).select("x.*")
    each = long.select("cutoff", "events", F.explode("ys").alias("n"))
    return each.groupBy("cutoff", "events").agg(geo.rounded(F.stddev_pop("n") / F.nullif(F.avg("n"), F.lit(0.0))).alias("yearly_cv"))
