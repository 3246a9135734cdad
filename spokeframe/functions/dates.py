"""Dates and times of rides as column expressions. The present moment is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_start(start_date_local: Column, start_date: Column) -> Column:
    """The ride's own wall clock: its Z is ignored; without it the UTC start counts in the session's time zone, which is UTC."""
    return F.to_timestamp_ntz(F.regexp_replace(F.coalesce(start_date_local, start_date), r"(Z|\+00:00)$", ""))


def week_label(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def period_bounds(period: str, now: str) -> tuple[Column | None, Column | None]:
    """First and last moment of a period; None where it is open."""
    at = F.to_timestamp_ntz(F.lit(now))
    year = F.date_trunc("year", at)
    starts = {
        "this_week": F.date_trunc("week", at),
        "this_month": F.date_trunc("month", at),
        "this_year": year,
        "last_30d": at - F.expr("interval 30 days"),
        "last_year": year - F.expr("interval 1 year"),
    }
    if period not in (*starts, "all_time"):
        raise ValueError(f"unknown period {period}")
    end = year - F.expr("interval 1 second") if period == "last_year" else None
    return starts.get(period), end


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock(seconds: Column) -> Column:
    s = seconds.cast("int")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (s / 60).cast("int") % 60, s % 60)


def next_commute_day(hour: Column, direction: str) -> Column:
    """Today until 10 for the way to work and until 18 for the way home, then tomorrow."""
    return F.when(hour < (10 if direction == "to_work" else 18), F.lit("today")).otherwise("tomorrow")


def dashboard_direction(ts: Column) -> Column:
    """What a dashboard shows first: on weekdays the way to work from 5 to 10 and the way home from 15 to 19."""
    hour = F.hour(ts)
    return (
        F.when(F.weekday(ts) >= 5, "weekend")
        .when(hour.between(5, 9), "to_work")
        .when(hour.between(15, 18), "to_home")
        .otherwise("off_peak")
    )


def departure_minute(start: Column, end: Column, precip_prob: Column) -> Column:
    """The middle of a window in minutes of the day, or half of the way there when rain is likely."""
    middle = F.floor((start + end) / 2)
    return F.when(precip_prob > 60, start + F.floor((middle - start) / 2)).otherwise(middle).cast("int")


def staleness(age_hours: Column, fresh: float = 2.0, usable: float = 24.0) -> Column:
    return F.when(age_hours < fresh, "fresh").when(age_hours < usable, "stale").otherwise("expired")
