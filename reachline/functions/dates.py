"""Elapsed time against an explicit as-of moment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from reachline.fixed import TIME_UNITS

AsOf = str | datetime | Column


def as_timestamp(as_of: AsOf) -> Column:
    """The as-of moment as a zone-less UTC timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def whole_days_since(ts: Column, as_of: AsOf) -> Column:
    """Full 24-hour periods from ``ts`` to the as-of moment, rounded down.

    A day is elapsed time, not a calendar step. Future moments give negative days.
    """
    moment = as_timestamp(as_of)
    days = F.timestamp_diff("DAY", ts, moment)
    # timestamp_diff cuts towards zero; step down once more for a started future day.
    partly_ahead = F.timestamp_add("DAY", days, ts) > moment
    return F.when(partly_ahead, days - 1).otherwise(days).cast("int")


def days_before(as_of: AsOf, days: Column | int) -> Column:
    """The moment a whole number of days before the as-of moment."""
    days = days if isinstance(days, Column) else F.lit(days)
    return as_timestamp(as_of) - F.make_dt_interval(days.cast("int"))


def time_ago(ts: Column, as_of: AsOf) -> Column:
    """Coarse age such as ``3 days ago``; a unit is used once more than one of it passed."""
    seconds = F.timestamp_diff("SECOND", ts, as_timestamp(as_of))
    label = F.when(ts.isNull(), "Never")
    for unit, length in TIME_UNITS.items():
        label = label.when(
            seconds > length,
            F.concat(F.floor(seconds / length).cast("string"), F.lit(f" {unit} ago")))
    return label.otherwise(F.concat(seconds.cast("string"), F.lit(" seconds ago")))


def stamp(ts: Column) -> Column:
    """Timestamp as text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
