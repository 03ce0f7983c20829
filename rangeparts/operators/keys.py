"""Checks of a table's partition key, and of the server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeparts import errors
from rangeparts.functions import calendar, names

MIN_VERSION, MAX_DRIFT_S = 14, 10


def key_error(strategy: Column, key: Column, type_name: Column, wanted_key: Column) -> Column:
    """The first thing that is wrong with a key, null if nothing is: type, partitioning, key, strategy."""
    return (
        F.when(names.key_type(type_name).isNull(), errors.UNSUPPORTED_KEY_TYPE)
        .when(strategy.isNull() | key.isNull(), errors.NOT_PARTITIONED)
        .when(key != wanted_key, errors.KEY_MISMATCH)
        .when(strategy != "RANGE", errors.UNSUPPORTED_STRATEGY)
    )


def key_errors(configs: DataFrame, settings: DataFrame) -> DataFrame:
    """(set_name, error) of every set; ``settings`` has (schema, table, definition, type_name), the first like "RANGE (at)"."""
    found = configs.join(settings, ["schema", "table"], "left")
    error = key_error(names.strategy("definition"), names.key("definition"), F.col("type_name"), F.col("partition_key"))
    return found.select("set_name", error.alias("error"))


def server_error(version: Column, server_time: Column, local_time: Column, minimum: int = MIN_VERSION) -> Column:
    """The first requirement that a server does not meet, null if it meets all: a known version, a new one, the same time."""
    number = names.major_version(version)
    return (
        F.when(number.isNull(), errors.UNKNOWN_VERSION)
        .when(number < minimum, errors.UNSUPPORTED_SERVER)
        .when(~calendar.same_clock(server_time, local_time, MAX_DRIFT_S), errors.TIME_DRIFT)
    )
