"""Dates (I08, C09, F08): month keys, circular days of the month, month steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_key(day: Column | str) -> Column:
    """yyyy-MM"""
    return F.date_format(_col(day), "yyyy-MM")


def day_of_month_distance(a: Column | str, b: Column | str) -> Column:
    """Days between two days of the month, the short way round a month of 31."""
    d = F.abs(_col(a) - _col(b))
    return F.least(d, 31 - d)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier)).cast("bigint")


def add_months(day: Column | str, months: Column | int) -> Column:
    """The same day of a later month, or that month's last day where it has none."""
    return F.add_months(_col(day), months)


def micros_between(earlier: Column | str, later: Column | str) -> Column:
    """Microseconds from one moment to a later one: what a limit is held against, since whole seconds hide that it has passed."""
    micros = lambda x: F.unix_micros(_col(x).cast("timestamp"))
    return micros(later) - micros(earlier)


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    """Whole seconds from one moment to a later one, rounded down."""
    return F.floor(micros_between(earlier, later) / 1_000_000)
