"""Date expressions. What the time is now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"


def la_day(as_of: Column) -> Column:
    """'Jul 02' of an instant (UTC) in Los Angeles."""
    return F.date_format(F.from_utc_timestamp(as_of, ZONE), "MMM dd")


def la_date(ts: Column, raw: Column) -> Column:
    """'July 1' in Los Angeles; what can't be parsed stays as it is."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, ZONE), "MMMM d"), raw)


def within_days(ts: Column, as_of: Column, days: int = 1) -> Column:
    """Not older than that many days; missing is false."""
    return F.coalesce(ts >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def same_utc_day(ts: Column, as_of: Column) -> Column:
    return F.coalesce(F.to_date(ts) == F.to_date(as_of), F.lit(False))


def age_in_days(ts: Column, as_of: Column) -> Column:
    return F.datediff(F.to_date(as_of), F.to_date(ts))


def season_years(day: Column) -> Column:
    """struct(summer, fall, spring, winter): the year of each season that is looked for on a day."""
    y, m = F.year(day), F.month(day)
    return F.struct(
        F.when(m >= 6, y + 1).otherwise(y).alias("summer"),
        F.when(m >= 9, y + 1).otherwise(y).alias("fall"),
        (y + 1).alias("spring"),
        (y + 1).alias("winter"),
    )
