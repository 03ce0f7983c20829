"""Names, identifiers and the texts that a catalog describes partitions with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of texts in a catalog.
BOUND = r"FOR VALUES FROM \('(.*)'\) TO \('(.*)'\)"
KEY = r"^(.*) \((.*)\)$"
VERSION = r"^[0-9]+"
# Names that a catalog may have for a type of key.
TYPE_NAMES = {
    "date": "date",
    "timestamp": "timestamp",
    "timestamp without time zone": "timestamp",
    "timestamp_ntz": "timestamp",
    "timestamp with time zone": "timestamp with time zone",
    "timestamptz": "timestamp with time zone",
    "uuid": "uuid",
}


def _extracted(text: Column | str, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def lower_bound(expression: Column | str) -> Column:
    """Lower bound in a bound expression; null if there is none, as for a default partition."""
    return _extracted(expression, BOUND, 1)


def upper_bound(expression: Column | str) -> Column:
    return _extracted(expression, BOUND, 2)


def strategy(definition: Column | str) -> Column:
    """RANGE of "RANGE (created_at)"; null if the table is not partitioned."""
    return _extracted(definition, KEY, 1)


def key(definition: Column | str) -> Column:
    return _extracted(definition, KEY, 2)


def major_version(text: Column | str) -> Column:
    """Leading number of a version; null without one."""
    return _extracted(text, VERSION, 0).cast("bigint")


def key_type(name: Column | str) -> Column:
    """One of the supported types of key, by any of its names; null for other types."""
    name = F.lower(F.col(name) if isinstance(name, str) else name)
    chosen = F.lit(None).cast("string")
    for known, kind in TYPE_NAMES.items():
        chosen = F.when(name == known, F.lit(kind)).otherwise(chosen)
    return chosen


def partition_name(table: Column | str, suffix: Column) -> Column:
    return F.concat_ws("_", table, suffix)


def segment_name(table: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Name of a part of an interval: logs_20250301_20250303."""
    return F.concat_ws("_", table, F.date_format(lo, "yyyyMMdd"), F.date_format(hi, "yyyyMMdd"))


def qualified(schema: Column | str, name: Column | str) -> Column:
    return F.concat_ws(".", schema, name)


def quoted(*names: str) -> str:
    """An identifier for SQL, with all its parts quoted."""
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)
