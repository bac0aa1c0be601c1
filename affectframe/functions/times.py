"""Dates of posts, calendar buckets and event windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names are checked by the expression, since date patterns only print them.
_WEEKDAY = r"^(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun) "
_POST_DATE = "MMM d HH:mm:ss Z yyyy"


def parse_post_date(value: Column) -> Column:
    """Timestamp of ``Wed Oct 10 20:19:24 +0000 2018``; null if malformed."""
    return F.when(
        value.rlike(_WEEKDAY), F.try_to_timestamp(F.substring(value, 5, 2**31 - 1), F.lit(_POST_DATE))
    )


def utc_naive(moment: Column) -> Column:
    """Zone-less timestamp showing UTC wall-clock time, whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


def utc_instant(naive: Column) -> Column:
    """The instant that a zone-less timestamp shows in UTC; the inverse of the above."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive).cast("timestamp")


def parse_datetime(value: Column) -> Column:
    """Zone-less UTC time of a post date or an ISO date or date-time; null if neither.

    Texts without a zone are taken as they are.
    """
    has_zone = value.rlike(r"\d[Tt ].*(?:[Zz]|[+-]\d{2}:?\d{2})$")
    iso = F.when(has_zone, utc_naive(F.try_to_timestamp(value))).otherwise(
        value.try_cast("timestamp_ntz")
    )
    return F.coalesce(utc_naive(parse_post_date(value)), iso)


def midnight(day: str, zone: str = "UTC") -> Column:
    """The instant at which a day (``yyyy-mm-dd``) begins in a zone."""
    year, month, dom = (F.lit(int(part)) for part in day.split("-"))
    zero = F.lit(0)
    return F.make_timestamp(year, month, dom, zero, zero, zero, F.lit(zone))


def event_bounds(event_date: str, months: int) -> tuple[Column, Column]:
    """Midnight ``months`` before and after an event, clamped to month ends; zone-less."""
    day = F.lit(event_date).cast("date")
    return (
        F.add_months(day, -months).cast("timestamp_ntz"),
        F.add_months(day, months).cast("timestamp_ntz"),
    )


def month_start(moment: Column) -> Column:
    return F.trunc(moment, "month")


def week_start(moment: Column) -> Column:
    """Monday of the week."""
    return F.trunc(moment, "week")


def whole_days(first: Column, last: Column) -> Column:
    """Complete days between two zone-less timestamps."""
    return F.extract(F.lit("DAY"), last - first).cast("bigint")
