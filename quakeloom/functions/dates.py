"""Times of raw catalogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PATTERN = r"^\s*(\d{1,2}) ([A-Z][a-z]+) (\d{4}) - (\d{1,2}):(\d{2}) ([AaPp][Mm])\s*$"


def parse_origin_time(text: Column) -> Column:
    """Seconds since 1970 of `D Month YYYY - H:MM AM`, or null.

    Days are checked against 31 only: a day that its month lacks rolls over into the next month. 12 AM is
    midnight; hours above 12 are taken as they are with AM, and must stay below 24 with PM.
    """
    fields = F.when(text.rlike(PATTERN), F.split(F.regexp_replace(text, PATTERN, "$1 $2 $3 $4 $5 $6"), " "))
    # a lambda names the fields once; spelled out, they would be parsed again at each use
    return F.get(F.transform(F.array(fields), _seconds), 0)


def _seconds(part: Column) -> Column:
    day, year, hour, minute = (F.get(part, n).cast("int") for n in (0, 2, 3, 4))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.get(part, 1)).cast("int")
    # 12 counts as 0 before PM adds its twelve hours
    hours = F.when(hour == 12, 0).otherwise(hour) + F.when(F.lower(F.get(part, 5)) == "pm", 12).otherwise(0)
    days = F.unix_date(F.make_date(year, F.nullif(month, F.lit(0)), F.lit(1))) + day - 1
    seconds = days.cast("long") * 86400 + hours * 3600 + minute * 60
    return F.when(day.between(1, 31) & (hours < 24) & (minute < 60), seconds)


def parse_free(text: Column) -> Column:
    """The same, or else any timestamp that the engine can read."""
    return F.coalesce(parse_origin_time(text), F.unix_seconds(F.try_to_timestamp(text)))


def fractional_year(seconds: Column, year: Column) -> Column:
    """The year plus the part of it that has passed, by its own length."""
    start = F.unix_date(F.make_date(year, F.lit(1), F.lit(1))).cast("long") * 86400
    end = F.unix_date(F.make_date(year + 1, F.lit(1), F.lit(1))).cast("long") * 86400
    return year + (seconds - start) / (end - start)
