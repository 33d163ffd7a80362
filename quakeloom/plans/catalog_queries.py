"""Queries on sources, validation, projections and magnitude diagnostics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions import geo
from quakeloom.functions.dates import fractional_year, parse_origin_time
from quakeloom.operators import diagnostics, features
from quakeloom.plans.oracle import CATALOG, KEPT, P, r6, sql
from quakeloom.session import cut, shared_folder
from quakeloom.sources import raw
from quakeloom.sources.derived import catalog
from quakeloom.streaming import scorer

QUERIES, ORACLE_SQL = {}, {}


def _query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return register


#: The catalog written as raw text rows, with some fields damaged by fixed residues.
RAW = f"""{CATALOG},
raw AS (SELECT event_id AS row_no,
  CASE WHEN event_id % 211 = 3 THEN 'bad-date' ELSE strftime(to_timestamp(sort_time) AT TIME ZONE 'UTC', '%d %B %Y - %I:%M %p') END AS "Date-Time",
  CASE WHEN event_id % 307 = 5 THEN 'x' ELSE printf('%.3f', latitude) END AS lat, printf('%.3f', longitude) AS lon, printf('%.1f', depth_km) AS depth,
  CASE WHEN event_id % 401 = 7 THEN 'not-a-number' ELSE printf('%.1f', magnitude) END AS mag, strftime(to_timestamp(sort_time) AT TIME ZONE 'UTC', '%Y') AS "Year" FROM catalog)"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived catalog in the raw file's text columns, with a row number."""
    c = catalog(spark, sf_dir)
    t = F.timestamp_seconds("sort_time")
    damaged = lambda m, r, bad, good: F.when(F.col("event_id") % m == r, bad).otherwise(good)
    rows = c.select(
        F.col("event_id").alias("row_no"),
        damaged(211, 3, "bad-date", F.date_format(t, "dd MMMM yyyy - hh:mm a")).alias("Date-Time"),
        damaged(307, 5, "x", F.format_string("%.3f", "latitude")).alias("Latitude"),
        F.format_string("%.3f", "longitude").alias("Longitude"),
        F.format_string("%.1f", "depth_km").alias("Depth"),
        damaged(401, 7, "not-a-number", F.format_string("%.1f", "magnitude")).alias("Magnitude"),
        F.lit("somewhere").alias("Location"),
        F.date_format(t, "MMMM").alias("Month"),
        F.date_format(t, "yyyy").alias("Year"),
    )
    return cut(rows)  # as a file would, it keeps the making of the text out of its parsing


def raw_files(spark, sf_dir):
    """The raw rows, written as CSV files in row order and read from there."""
    path = f"{shared_folder(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    rows = raw_rows(spark, sf_dir)
    rows.repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no").write.csv(path, header=True, quote='"', escape='"')
    return raw.read_csv(spark, path)


_VALID = "\"Date-Time\" <> 'bad-date' AND lat <> 'x' AND mag <> 'not-a-number'"


@_query(sql(RAW, f"""SELECT row_number() OVER (ORDER BY row_no) AS event_id, epoch_us(strptime("Date-Time", '%d %B %Y - %I:%M %p')) // 1000000 AS sort_time,
  lat::DOUBLE AS latitude, lon::DOUBLE AS longitude, depth::DOUBLE AS depth_km, mag::DOUBLE AS magnitude FROM raw WHERE {_VALID}"""))
def catalog_normalized(spark, sf_dir):
    """Raw text rows parsed, invalid ones dropped, numbered in file order."""
    return raw.catalog(raw_rows(spark, sf_dir)).select("event_id", "sort_time", "latitude", "longitude", "depth_km", "magnitude")


@_query(sql(RAW, f"""SELECT row_number() OVER (ORDER BY row_no) AS event_id, epoch_us(strptime("Date-Time", '%d %B %Y - %I:%M %p')) // 1000000 AS sort_time,
  lat::DOUBLE AS latitude, lon::DOUBLE AS longitude, depth::DOUBLE AS depth_km, mag::DOUBLE AS magnitude FROM raw WHERE {_VALID}"""))
def catalog_from_files(spark, sf_dir):
    """The same from CSV files, whose rows are numbered across files and blocks."""
    return raw.catalog(raw_files(spark, sf_dir)).select("event_id", "sort_time", "latitude", "longitude", "depth_km", "magnitude")


@_query(sql(RAW, f"""SELECT epoch_us(strptime("Date-Time", '%d %B %Y - %I:%M %p')) // 1000000 AS sort_time, lat::DOUBLE AS latitude, lon::DOUBLE AS longitude, depth::DOUBLE AS depth_km,
  mag::DOUBLE AS magnitude FROM raw WHERE {_VALID}"""))
def catalog_serving(spark, sf_dir):
    """The serving form of the files' complete rows."""
    return raw.normalized(raw_files(spark, sf_dir))


@_query(sql(RAW, f"""SELECT count(*) AS total_rows, count(*) FILTER ({_VALID}) AS valid_rows, count(*) FILTER ("Date-Time" = 'bad-date') AS invalid_datetime,
  count(*) FILTER (lat = 'x') AS invalid_latitude, 0::BIGINT AS invalid_longitude, 0::BIGINT AS invalid_depth, count(*) FILTER (mag = 'not-a-number') AS invalid_magnitude,
  0::BIGINT AS invalid_year FROM raw"""))
def validation_report(spark, sf_dir):
    return raw.validation_report(raw.parsed(raw_rows(spark, sf_dir)))


@_query(sql(RAW, """SELECT count(*) FILTER ("Date-Time" = 'bad-date') AS bad_dates, count(*) FILTER (lat = 'x' OR mag = 'not-a-number') AS bad_numbers,
  count(*) FILTER (lon::DOUBLE NOT BETWEEN 115 AND 130) AS implausible_longitudes FROM raw"""))
def input_gate(spark, sf_dir):
    return raw.input_gate(raw.parsed(raw_rows(spark, sf_dir)))


@_query(sql(CATALOG, "SELECT event_id, sort_time, strftime(to_timestamp(sort_time) AT TIME ZONE 'UTC', '%d %B %Y - %I:%M %p') AS origin_time FROM catalog"))
def datetime_roundtrip(spark, sf_dir):
    """Times to text and back."""
    text = F.date_format(F.timestamp_seconds("sort_time"), "dd MMMM yyyy - hh:mm a")
    return catalog(spark, sf_dir).select("event_id", parse_origin_time(text).alias("sort_time"), text.alias("origin_time"))


@_query(sql(CATALOG, f"""SELECT event_id, {r6("y + (sort_time - epoch(make_date(y, 1, 1))) / (epoch(make_date(y + 1, 1, 1)) - epoch(make_date(y, 1, 1)))", 9)} AS origin_time_years
  FROM (SELECT *, year(to_timestamp(sort_time) AT TIME ZONE 'UTC')::INT AS y FROM catalog)"""))
def origin_time_years(spark, sf_dir):
    return catalog(spark, sf_dir).select("event_id", geo.rounded(fractional_year(F.col("sort_time"), F.year(F.timestamp_seconds("sort_time"))), 9).alias("origin_time_years"))


@_query(sql(KEPT, "SELECT * FROM kept"))
def magnitude_filter(spark, sf_dir):
    return catalog(spark, sf_dir).where(F.col("magnitude") >= P.m_c)


@_query(sql(CATALOG, """SELECT event_id, year(t)::INT AS event_year, month(t)::INT AS event_month, dayofyear(t)::INT AS event_dayofyear, hour(t)::INT AS event_hour, (isodow(t) - 1)::INT AS event_weekday
  FROM (SELECT event_id, to_timestamp(sort_time) AT TIME ZONE 'UTC' AS t FROM catalog)"""))
def time_parts(spark, sf_dir):
    return features.time_parts(catalog(spark, sf_dir)).select("event_id", "event_year", "event_month", "event_dayofyear", "event_hour", "event_weekday")


@_query(sql(CATALOG, f"SELECT event_id, {r6('magnitude * exp(-depth_km / 50e0)')} AS rupture_depth_attenuation, {r6('magnitude - 1.2e0')} AS baths_law_limit, {r6('log10(pow(10e0, 1.5e0 * magnitude))')} AS log10_energy FROM catalog"))
def advanced_features(spark, sf_dir):
    done = features.physics(catalog(spark, sf_dir))
    energy = F.log10(F.pow(F.lit(10.0), F.col("magnitude") * 1.5))
    return done.select("event_id", geo.rounded(F.col("rupture_depth_attenuation")).alias("rupture_depth_attenuation"), geo.rounded(F.col("baths_law_limit")).alias("baths_law_limit"), geo.rounded(energy).alias("log10_energy"))


_BINS = "SELECT floor(i * 0.1e0 * 1e3 + 0.5e0) / 1e3 AS bin_lower, floor((i + 1) * 0.1e0 * 1e3 + 0.5e0) / 1e3 AS bin_upper, count(*) AS event_count FROM (SELECT floor((magnitude + 1e-9) / 0.1e0)::BIGINT AS i FROM catalog) GROUP BY i"


@_query(sql(CATALOG, _BINS))
def magnitude_bins(spark, sf_dir):
    return diagnostics.magnitude_bins(catalog(spark, sf_dir))


_TENTHS = """ends AS (SELECT floor(min(magnitude) * 10 + 1e-9)::BIGINT AS a, floor(max(magnitude) * 10 + 1e-9)::BIGINT AS b FROM catalog),
cuts AS (SELECT unnest(range(a, b + 1)) AS tenths FROM ends)"""


@_query(sql(f"{CATALOG}, {_TENTHS}", "SELECT tenths / 1e1 AS cutoff, (SELECT count(*) FROM catalog WHERE floor(magnitude * 10 + 1e-9) >= tenths) AS event_count FROM cuts"))
def magnitude_cutoffs(spark, sf_dir):
    return diagnostics.cutoff_counts(catalog(spark, sf_dir))


@_query(sql(f"{CATALOG}, {_TENTHS}, y AS (SELECT *, year(to_timestamp(sort_time) AT TIME ZONE 'UTC')::BIGINT AS year FROM catalog)",
            """SELECT g.year, tenths / 1e1 AS cutoff, count(y.event_id) AS event_count FROM (SELECT DISTINCT year FROM y) g CROSS JOIN cuts
  LEFT JOIN y ON y.year = g.year AND floor(y.magnitude * 10 + 1e-9) >= tenths GROUP BY g.year, tenths"""))
def yearly_cutoffs(spark, sf_dir):
    return diagnostics.yearly_cutoff_counts(catalog(spark, sf_dir))


@_query(sql(CATALOG, f"SELECT year(to_timestamp(sort_time) AT TIME ZONE 'UTC')::BIGINT AS year, count(*) AS events, {r6('count(*) * 100e0 / sum(count(*)) OVER ()')} AS percent FROM catalog GROUP BY 1"))
def yearly_share(spark, sf_dir):
    return diagnostics.yearly_share(catalog(spark, sf_dir))


@_query(sql(f"{CATALOG}, bins AS ({_BINS})", "SELECT * FROM bins ORDER BY event_count DESC, bin_lower LIMIT 1"))
def mc_maxc(spark, sf_dir):
    return diagnostics.max_curvature(catalog(spark, sf_dir))


_CUTS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]


@_query(sql(f"{CATALOG}, cuts(cutoff) AS (VALUES {', '.join(f'({c}e0)' for c in _CUTS)}), years(y) AS (SELECT unnest(range(2018, 2026)))",
            f"""SELECT cutoff, any_value(events) AS events, {r6('stddev_pop(n) / avg(n)')} AS yearly_cv FROM (
  SELECT cutoff, y, (SELECT count(*) FROM catalog WHERE magnitude >= cutoff AND year(to_timestamp(sort_time) AT TIME ZONE 'UTC') = y) AS n,
    (SELECT count(*) FROM catalog WHERE magnitude >= cutoff) AS events FROM cuts, years) GROUP BY cutoff"""))
def mc_yearly_cv(spark, sf_dir):
    return diagnostics.yearly_variation(catalog(spark, sf_dir), _CUTS, (2018, 2025))


@_query(sql(f"""{CATALOG}, celled AS (SELECT *, floor(latitude)::BIGINT AS y, floor(longitude)::BIGINT AS x FROM catalog),
marked AS (SELECT *, coalesce(sort_time - lag(sort_time) OVER (PARTITION BY y, x ORDER BY sort_time, event_id) > 86400, true)::INT AS first FROM celled),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY y, x ORDER BY sort_time, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM marked)""",
            "SELECT y AS cell_row, x AS cell_column, min(sort_time) AS start_time, max(sort_time) + 86400 AS end_time, count(*) AS events, max(magnitude) AS largest FROM numbered GROUP BY y, x, burst"))
def event_bursts(spark, sf_dir):
    """Runs of events in a cell of one degree that follow each other by at most a day."""
    found = scorer.bursts(catalog(spark, sf_dir), "1 day")
    return found.select(F.col("row").alias("cell_row"), F.col("column").alias("cell_column"), F.unix_timestamp("start").alias("start_time"), F.unix_timestamp("end").alias("end_time"), "events", "largest")
