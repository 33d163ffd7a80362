"""Row numbers and counts along time without a single-task window.

Rows are dealt into time buckets. Buckets are counted and the counts summed up over the short list of
buckets; inside a bucket a window numbers the rows. Buckets of equal width suit catalogs, where a
bucket's rows are a small part of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 30 * 86400


def _offsets(counted: DataFrame) -> DataFrame:
    """_bucket and the rows before it. counted: _bucket and n, one row per bucket."""
    before = F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))


def numbered(df: DataFrame, time: str, *ties: str, name: str = "row_no", bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """`df` with a row number from 1 in the order of (time, ties)."""
    placed = df.withColumn("_bucket", F.floor(F.col(time) / bucket_seconds))
    before = _offsets(placed.groupBy("_bucket").agg(F.count("*").alias("n")))
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy(time, *ties))
    return placed.withColumn("_inner", inner).join(before, "_bucket").withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_bucket", "_inner", "_before")


def counted_before(events: DataFrame, time: str, queries: DataFrame, at: str, keys: list[str], name: str, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """keys of `queries` and how many events have a time before `at`."""
    bucket = lambda c: F.floor(c / bucket_seconds)
    points = queries.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_event"))
    own = events.select(*(F.lit(None).cast(dict(queries.dtypes)[k]).alias(k) for k in keys), F.col(time).alias("_t"), F.lit(1).alias("_event"))
    both = own.unionByName(points).withColumn("_bucket", bucket(F.col("_t")))
    before = _offsets(both.groupBy("_bucket").agg(F.sum("_event").alias("n")))
    earlier = F.sum("_event").over(Window.partitionBy("_bucket").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("_n", F.coalesce(earlier, F.lit(0))).where("_event = 0").join(before, "_bucket")
    return found.select(*keys, (F.col("_before") + F.col("_n")).cast("long").alias(name))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in this order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
