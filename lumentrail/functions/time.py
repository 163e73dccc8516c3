"""Times: whole units, day parts, seasons and labels. Nothing reads the clock; ``now`` is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def whole_hours(start: Column, end: Column) -> Column:
    """Hours between two times, cut towards zero."""
    return F.timestamp_diff("HOUR", start, end)


def whole_days(start: Column, end: Column) -> Column:
    return F.timestamp_diff("DAY", start, end)


def recency(created: Column, now: Column) -> Column:
    """1 up to a day, then falling by e in 30 days."""
    days = whole_days(created, now)
    return F.when(days <= 0, 1.0).otherwise(F.exp(-days / 30.0))


def day_part(t: Column) -> Column:
    h = F.hour(t)
    return F.when((h >= 5) & (h < 12), "Morning").when((h >= 12) & (h < 17), "Afternoon").when((h >= 17) & (h < 21), "Evening").otherwise("Late Night")


def season(t: Column) -> Column:
    """Of the northern half."""
    m = F.month(t)
    return F.when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall").otherwise("Winter")


def timeline_label(t: Column, now: Column) -> Column:
    """Today, Yesterday, month and day, with the year where it is another."""
    days = F.date_diff(F.to_date(now), F.to_date(t))
    return (
        F.when(days == 0, "Today").when(days == 1, "Yesterday")
        .when(F.year(t) == F.year(now), F.date_format(t, "MMMM d"))
        .otherwise(F.date_format(t, "MMMM d, yyyy"))
    )


def days_left(deleted: Column, now: Column, kept_days: int = 30) -> Column:
    """Days until a deleted row is purged, within 0 and ``kept_days``."""
    return F.greatest(F.lit(0), F.least(F.lit(kept_days), kept_days - whole_days(deleted, now)))


def clock(milliseconds: Column) -> Column:
    """mm:ss."""
    seconds = F.floor(milliseconds / 1000)
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
