"""Raw catalogs: text files, parsing, validation, and what is written."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeloom.functions.dates import fractional_year, parse_free, parse_origin_time
from quakeloom.functions.ordering import numbered
from quakeloom.session import cut

#: Columns of a raw file.
REQUIRED = ("Date-Time", "Latitude", "Longitude", "Depth", "Magnitude", "Location", "Month", "Year")
NUMBERS = {"latitude": "Latitude", "longitude": "Longitude", "depth_km": "Depth", "magnitude": "Magnitude"}
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
LONGITUDES = (115.0, 130.0)


def check_header(columns: list[str], required: tuple[str, ...] = REQUIRED) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of raw files as text, with row_no in file order. Columns may stand in any order; a byte order
    mark is dropped, blank lines are skipped, quotes are doubled inside quoted fields."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    check_header(df.columns)
    # a row's place: its file, its block of that file, and its order there
    placed = df.select(*df.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    counts = placed.groupBy("_file", "_start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_file", "_start", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_row"))
    out = placed.withColumn("_inner", inner).join(counts, ["_file", "_start"]).withColumn("row_no", F.col("_before") + F.col("_inner"))
    return out.drop("_file", "_start", "_row", "_before", "_inner")


def number(text: Column) -> Column:
    """A finite number that takes up the whole text, or null."""
    value = F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parsed(rows: DataFrame) -> DataFrame:
    """Raw rows with sort_time and numbers, null where they can't be parsed, and `valid`."""
    check_header(rows.columns)
    values = {name: number(F.col(c)) for name, c in NUMBERS.items()} | {"year": number(F.col("Year")).cast("int"), "sort_time": parse_origin_time(F.col("Date-Time"))}
    out = rows.withColumns(values)
    all_there = F.lit(True)
    for name in values:
        all_there = all_there & F.col(name).isNotNull()
    return out.withColumn("valid", all_there)


def validation_report(rows: DataFrame) -> DataFrame:
    """Counts of parsed rows: total, valid, and invalid per field. A row may count in several."""
    missing = {"invalid_datetime": "sort_time", "invalid_latitude": "latitude", "invalid_longitude": "longitude", "invalid_depth": "depth_km", "invalid_magnitude": "magnitude", "invalid_year": "year"}
    return rows.agg(F.count("*").alias("total_rows"), F.count_if(F.col("valid")).alias("valid_rows"), *(F.count_if(F.col(c).isNull()).alias(n) for n, c in missing.items()))


def input_gate(rows: DataFrame) -> DataFrame:
    """Counts that must be zero before a catalog is used."""
    numbers = F.lit(False)
    for c in NUMBERS:
        numbers = numbers | F.col(c).isNull()
    return rows.agg(
        F.count_if(F.col("sort_time").isNull()).alias("bad_dates"), F.count_if(numbers).alias("bad_numbers"), F.count_if(~F.col("longitude").between(*LONGITUDES)).alias("implausible_longitudes")
    )


def catalog(rows: DataFrame) -> DataFrame:
    """Valid rows with event_id in file order (row_no); time order is left to those who need it."""
    needed = ["row_no", "Date-Time", "Location", "Month", "sort_time", "year", *NUMBERS]
    good = cut(parsed(rows).where("valid").select(*needed))  # numbering reads the rows twice
    good = numbered(good, "row_no", name="event_id", bucket_seconds=100_000)
    years = fractional_year(F.col("sort_time"), F.col("year"))
    return good.select("event_id", F.col("Date-Time").alias("origin_time"), "sort_time", *NUMBERS, F.col("Location").alias("location_text"), F.col("Month").alias("month"), "year", years.alias("origin_time_years"))


def normalized(rows: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Serving form: five columns, any time text, incomplete rows dropped; an error if none is left.

    `seen` gets the number of rows and of skipped_rows from the first job that reads the result whole, without a pass of its own."""
    check_header(rows.columns, ("Date-Time", *NUMBERS.values()))
    read = rows.select(parse_free(F.col("Date-Time")).alias("sort_time"), *(number(F.col(c)).alias(n) for n, c in NUMBERS.items()))
    if read.dropna().isEmpty():
        raise ValueError("the catalog has no usable row")
    if seen is not None:
        gap = reduce(or_, (F.col(c).isNull() for c in read.columns))
        read = read.observe(seen, F.count("*").alias("rows"), F.count_if(gap).alias("skipped_rows"))
    return read.dropna()


EVENT = T.StructType([T.StructField("sort_time", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in NUMBERS)])


def one_event(spark: SparkSession, origin_time: str, latitude: float, longitude: float, depth_km: float, magnitude: float) -> DataFrame:
    """A table of one event to score, with event_id 0."""
    row = spark.range(1).select(parse_free(F.lit(origin_time)).alias("sort_time"), *(F.lit(float(x)).alias(n) for n, x in zip(NUMBERS, (latitude, longitude, depth_km, magnitude))))
    if row.where("sort_time IS NULL").count():
        raise ValueError(f"unreadable time: {origin_time}")
    return row.withColumn("event_id", F.lit(0).cast("long"))


def single_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """The event of a file that must hold exactly one."""
    rows = normalized(read_csv(spark, path))
    if len(rows.take(2)) != 1:
        raise ValueError("the file must hold exactly one event")
    return rows.withColumn("event_id", F.lit(0).cast("long"))


def labelled(training: DataFrame, years: tuple[int | None, int | None], m_min: float, needed: list[str]) -> DataFrame:
    """Rows of a training set to test on: complete in `needed`, of these years and magnitudes."""
    check_header(training.columns, tuple(needed))
    year = F.year(F.timestamp_seconds("sort_time"))
    out = training.dropna(subset=needed).where(F.col("magnitude") >= m_min)
    if years[0] is not None:
        out = out.where(year >= years[0])
    return out.where(year <= years[1]) if years[1] is not None else out
