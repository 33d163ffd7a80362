"""Events that arrive as a stream, scored against the history by the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quakeloom.operators import features, models
from quakeloom.sources import raw

RAW = T.StructType([T.StructField(c, T.StringType()) for c in raw.REQUIRED])


def raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Valid events of raw files as they arrive; ids are hashes of their fields."""
    rows = raw.parsed(spark.readStream.csv(folder, schema=RAW, header=True, quote='"', escape='"')).where("valid")
    return rows.select(F.xxhash64("Date-Time", "Latitude", "Longitude", "Depth", "Magnitude").alias("event_id"), "sort_time", *raw.NUMBERS)


def hourly_rate(events: DataFrame, late: str = "2 days", width: str = "1 hour") -> DataFrame:
    """Events and the largest magnitude per window of event time; windows close when `late` has passed."""
    timed = events.withColumn("event_time", F.timestamp_seconds("sort_time")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width)).agg(F.count("*").alias("events"), F.max("magnitude").alias("largest")).select("window.start", "window.end", "events", "largest")


def bursts(events: DataFrame, gap: str = "1 hour", late: str = "2 days", degrees: float = 1.0) -> DataFrame:
    """row, column, start, end, events, largest of each run of events in one cell of so many degrees that follow each other
    by at most `gap`.

    `end` is the last event's time plus the gap. On a stream each burst is handed out once, when `late` has passed since its
    end; events that come later than that are left out. On a table all bursts come at once. Events without time or place are
    left out. Cells keep the runs apart, so that no task has to see the events of the whole world.
    """
    known = events.where(F.col("sort_time").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    timed = known.withColumn("event_time", F.timestamp_seconds("sort_time")).withWatermark("event_time", late)
    cell = (F.floor(F.col(c) / F.lit(degrees)).alias(n) for c, n in (("latitude", "row"), ("longitude", "column")))
    found = timed.groupBy(*cell, F.session_window("event_time", gap).alias("burst")).agg(F.count("*").alias("events"), F.max("magnitude").alias("largest"))
    return found.select("row", "column", "burst.start", "burst.end", "events", "largest")


def score_stream(events: DataFrame, history: Callable[[], DataFrame], model: models.Model, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch with the history of its time and hands (scores, batch number) to `sink`.

    A batch that is run again after a failure gives the same scores; `sink` should write by batch number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        once = rows.dropDuplicates(["event_id"])
        sink(models.as_json(models.score(model, features.serve(once, history()))), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
