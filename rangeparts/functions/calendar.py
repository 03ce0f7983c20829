"""Floors, steps and names of calendar intervals, as Column expressions.

A date column that is given may be a date or a timestamp; the interval may be a Python string or a
column of strings, so that sets with different intervals are planned in one query. An interval
that is not known raises when the expression is evaluated, or gives null from the ``try_`` forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeparts.errors import UNSUPPORTED_INTERVAL

ColumnOrName = Column | str

#: Unit that ``trunc`` knows, and months of an interval (days for the first two).
_UNITS = {"weekly": "WEEK", "monthly": "MM", "quarterly": "QUARTER", "yearly": "YEAR"}
_DAYS = {"daily": 1, "weekly": 7}
_MONTHS = {"monthly": 1, "quarterly": 3, "yearly": 12}


def _by_interval(interval: ColumnOrName, of: dict[str, Column], strict: bool = True) -> Column:
    """The expression of the interval: picked at once if that is a plain string, by CASE if it is a column."""
    if isinstance(interval, str):
        if interval not in of:
            raise ValueError(f"{UNSUPPORTED_INTERVAL}: {interval}")
        return of[interval]
    chosen = None
    for name, value in of.items():
        chosen = F.when(interval == name, value) if chosen is None else chosen.when(interval == name, value)
    if not strict:
        return chosen
    return chosen.otherwise(F.raise_error(F.concat(F.lit(f"{UNSUPPORTED_INTERVAL}: "), F.coalesce(interval, F.lit("null")))))


def _date(date: ColumnOrName) -> Column:
    return (F.col(date) if isinstance(date, str) else date).cast("date")


def floor(date: ColumnOrName, interval: ColumnOrName, strict: bool = True) -> Column:
    """First day of the interval that the date is in; weeks begin on Monday."""
    d = _date(date)
    return _by_interval(interval, {"daily": d} | {k: F.trunc(d, u) for k, u in _UNITS.items()}, strict)


def following(lo: ColumnOrName, interval: ColumnOrName, strict: bool = True) -> Column:
    """First day of the next interval, from the first day of one."""
    return step(lo, interval, 1, strict)


def step(date: ColumnOrName, interval: ColumnOrName, i: Column | int, strict: bool = True) -> Column:
    """The date i intervals on, or back if i is negative.

    Days and weeks are counted from the date itself; months, quarters and years from the first day of
    the one that it is in, so the 31st steps to the month before and not over it.
    """
    d, i = _date(date), F.lit(i) if isinstance(i, int) else i
    of = {k: F.date_add(d, (i * n).cast("int")) for k, n in _DAYS.items()}
    of |= {k: F.add_months(F.trunc(d, _UNITS[k]), (i * n).cast("int")) for k, n in _MONTHS.items()}
    return _by_interval(interval, of, strict)


def suffix(date: ColumnOrName, interval: ColumnOrName, strict: bool = True) -> Column:
    """Name of the interval: 2024_02_29, 2024_w09 (year and week of ISO 8601), 2024_02, 2024_q1, 2024."""
    d = _date(date)
    of = {
        "daily": F.date_format(d, "yyyy_MM_dd"),
        "weekly": F.format_string("%d_w%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)),
        "monthly": F.date_format(d, "yyyy_MM"),
        "quarterly": F.format_string("%d_q%d", F.year(d), F.quarter(d)),
        "yearly": F.date_format(d, "yyyy"),
    }
    return _by_interval(interval, of, strict)


def naive(date: ColumnOrName) -> Column:
    """Midnight of the date, without a zone."""
    return _date(date).cast("timestamp_ntz")


def same_clock(a: ColumnOrName, b: ColumnOrName, seconds: int = 10) -> Column:
    """Whether two instants are at most so many seconds apart."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) <= seconds * 1_000_000
