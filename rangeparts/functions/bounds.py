"""Bounds of partitions: texts of a catalog to wall-clock times, and back by the type of the key.

Both bounds of a partition have to be of one form. A zone's offset is dropped and not applied, as bounds
are what the clock shows; only offsets in whole hours are known.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeparts.errors import UNDECODABLE_BOUNDS, UNSUPPORTED_KEY_TYPE
from rangeparts.functions import uuid7

DAY = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
CLOCK = " [0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?"
OFFSET = "[+-][0-9]{2}$"


def _as(text: Column, form: str) -> Column:
    """The time that a text of this form shows; null for a text of another form or a day that does not exist."""
    return F.when(text.rlike(f"^{form}$"), text.try_cast("timestamp_ntz"))


def parsed(lower: Column | str, upper: Column | str) -> Column:
    """Struct (lo, hi) of two texts; null if they are not both dates, times, times with an offset, or UUIDv7."""
    lower, upper = (F.col(c) if isinstance(c, str) else c for c in (lower, upper))

    def both(of, condition: Column | None = None) -> Column:
        lo, hi = of(lower), of(upper)
        known = lo.isNotNull() & hi.isNotNull()
        return F.when(known if condition is None else known & condition, F.struct(lo.alias("lo"), hi.alias("hi")))

    offsets = lower.rlike(OFFSET) & upper.rlike(OFFSET)
    return F.coalesce(
        both(lambda x: _as(x, DAY)),
        both(lambda x: _as(x, DAY + CLOCK)),
        both(lambda x: _as(F.regexp_replace(x, OFFSET, ""), DAY + CLOCK), offsets),
        both(uuid7.to_time),
    )


def parse_error(lower: Column | str, upper: Column | str) -> Column:
    """UNDECODABLE_BOUNDS where ``parsed`` is null, else null."""
    return F.when(parsed(lower, upper).isNull(), F.lit(UNDECODABLE_BOUNDS))


def formatted(at: Column | str, key_type: Column | str) -> Column:
    """Text of a bound for a key type: a date, a midnight, or the first UUIDv7 of that midnight.

    ``key_type`` is a column, or a type's name as a plain string.
    """
    at = F.col(at) if isinstance(at, str) else at
    kind = F.lit(key_type) if isinstance(key_type, str) else key_type
    day = F.date_format(at.cast("date"), "yyyy-MM-dd")
    return (
        F.when(kind == "date", day)
        .when(kind.isin("timestamp", "timestamp with time zone"), F.concat(day, F.lit(" 00:00:00")))
        .when(kind == "uuid", uuid7.from_time(at.cast("date")))
        .otherwise(F.raise_error(F.concat(F.lit(f"{UNSUPPORTED_KEY_TYPE}: "), F.coalesce(kind, F.lit("null")))))
    )


def display(lo: Column | str, hi: Column | str) -> Column:
    """A range for people: [ 01-02-2024 , 01-03-2024 ]."""
    return F.format_string("[ %s , %s ]", F.date_format(lo, "dd-MM-yyyy"), F.date_format(hi, "dd-MM-yyyy"))
