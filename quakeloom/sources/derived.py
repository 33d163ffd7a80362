"""An earthquake catalog made from the `events` table, the same at every engine that runs the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakeloom.session import table

#: `{epoch_us}` is the engine's name for microseconds since 1970 of a timestamp, `{events}` the table.
CATALOG_SQL = """
with lead as (
  select event_id as lid, ts as lts, user_id as luid, value as lval from {events} where event_id % 50 = 0),
b as (
  select e.event_id, e.value, e.user_id, e.ts, l.lts, l.luid, l.lval,
    cast(e.event_id % 50 as int) as k, cast((e.event_id - e.event_id % 50) / 50 as int) as g
  from {events} e join lead l on l.lid = e.event_id - e.event_id % 50),
s as (
  select event_id, value, lval, user_id, luid, k, g, k <= 17 as seq,
    case when k = 6 and g % 3 = 0 then 5 else k end as kt,
    case when k = 7 and g % 5 = 0 then event_id - 3 else event_id end as lo,
    {epoch_us}(cast(case when k <= 17 then lts else ts end as timestamp)) as us
  from b)
select event_id + 1 as event_id,
  1514764800 + 60 * cast(floor((1e2 * ((us - 1704067200000000) / 1e6) + (case when seq then 1800 * kt * kt else 0 end)) / 6e1) as bigint) as sort_time,
  floor((case when seq then 6 + luid % 13 + ((lo * 37) % 101 - 50) * 7e-4 else 5 + user_id % 15 + ((lo * 53) % 997) * 1e-3 end) * 1e3 + 5e-1) / 1e3 as latitude,
  floor((case when seq then 119 + luid % 8 + ((lo * 61) % 103 - 51) * 7e-4 else 118 + user_id % 10 + ((lo * 71) % 991) * 1e-3 end) * 1e3 + 5e-1) / 1e3 as longitude,
  cast(1 + (event_id * 29) % 90 as double) as depth_km,
  floor((case when k = 3 or (k = 5 and g % 7 = 0) then 4.5e0 + lval / 1e2 when k = 0 then 3e0 + value / 2e2 else 9e-1 + value / 1.15e2 end) * 1e1 + 5e-1) / 1e1 as magnitude
from s
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, sort_time (seconds), latitude, longitude, depth_km, magnitude."""
    return spark.sql(CATALOG_SQL.replace("{epoch_us}", "unix_micros"), events=table(spark, sf_dir, "events"))
