"""UUIDv7 as canonical lower-case strings, whose order is that of their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYNTAX = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_time(at: Column | str) -> Column:
    """The least UUIDv7 of a wall-clock time (taken as UTC): its 48 bits of milliseconds, version and variant, zeros.

    Times before 1970 have none: they raise.
    """
    at = _column(at).cast("timestamp_ntz")
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    digits = F.substr(F.lpad(F.lower(F.hex(ms)), 16, "0"), F.lit(5))
    text = F.concat(F.substr(digits, F.lit(1), F.lit(8)), F.lit("-"), F.substr(digits, F.lit(9), F.lit(4)), F.lit("-7000-8000-000000000000"))
    return F.when(at >= F.lit("1970-01-01").cast("timestamp_ntz"), text).when(
        at.isNotNull(), F.raise_error(F.lit("a time before 1970 has no UUIDv7"))
    )


def is_uuid(text: Column | str) -> Column:
    return F.lower(_column(text)).rlike(SYNTAX)


def is_v7(text: Column | str) -> Column:
    """Whether a text is a UUID of version 7, of any variant."""
    text = F.lower(_column(text))
    return text.rlike(SYNTAX) & (F.substr(text, F.lit(15), F.lit(1)) == "7")


def to_time(text: Column | str) -> Column:
    """Wall-clock time in UTC of a UUIDv7; null for any other text."""
    text = F.lower(_column(text))
    ms = F.conv(F.substr(F.regexp_replace(text, "-", ""), F.lit(1), F.lit(12)), 16, 10).cast("bigint")
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.floor(ms / 86_400_000).cast("int"), secs=((ms % 86_400_000) / 1000).cast("decimal(18,6)"))
    return F.when(is_v7(text), at)
