"""Date expressions on ``timestamp_ntz``; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


HOUR = 3600


def _epoch(ts: str) -> str:
    return (
        f"(unix_date(CAST({ts} AS DATE)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60"
        f" + second({ts}))"
    )


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, named."""
    return F.expr(_epoch(ts))


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, named."""
    return F.expr(f"{_epoch(ts)} * 1000000L + CAST((date_part('SECOND', {ts}) - second({ts})) * 1000000 AS BIGINT)")


def slot(ts: str, seconds: int = HOUR) -> Column:
    """Number of the time slot a timestamp column, named, falls into."""
    return F.expr(f"CAST(floor({_epoch(ts)} / {int(seconds)}) AS BIGINT)")


def shift_minutes(ts: Column, minutes: int) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(int(minutes)))


def monday_week(date: Column) -> Column:
    """First day of the Monday-based week."""
    return F.date_trunc("week", date).cast("date")


def sunday_week_label(date: Column) -> Column:
    """Year and week number, weeks starting on Sunday, days before the first Sunday in week 00."""
    week = F.floor((F.dayofyear(date) + 7 - F.dayofweek(date)) / 7).cast("string")
    return F.concat(F.date_format(date, "yyyy"), F.lit("-"), F.lpad(week, 2, "0"))


def day_label(date: Column) -> Column:
    return F.date_format(date, "MMMM dd, yyyy")
