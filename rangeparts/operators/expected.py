"""Generators: the partitions that configurations ask for on a work date."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeparts.functions import calendar, names


def partition_for(date: Column | str, interval: Column | str, table: Column | str) -> Column:
    """Struct (name, lo, hi) of the partition of a table that a date is in."""
    lo = calendar.floor(date, interval)
    return F.struct(
        names.partition_name(table, calendar.suffix(date, interval)).alias("name"),
        calendar.naive(lo).alias("lo"),
        calendar.naive(calendar.following(lo, interval)).alias("hi"),
    )


def _generated(configs: DataFrame, work_date: datetime.date | Column, first: Column, last: Column) -> DataFrame:
    date = work_date if isinstance(work_date, Column) else F.lit(work_date)
    steps = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = configs.withColumn("i", F.explode(steps)).withColumn(
        "p", partition_for(calendar.step(date, F.col("interval"), F.col("i")), F.col("interval"), F.col("table"))
    )
    return rows.select("set_name", F.col("table").alias("parent_table"), "schema", "p.name", "p.lo", "p.hi", "i")


def expected_partitions(configs: DataFrame, work_date: datetime.date | Column) -> DataFrame:
    """All partitions of all sets: ``retention`` before the work date's, that one, ``pre_provisioned`` after it.

    One row each, retention + 1 + pre_provisioned of them a set; ``i`` counts from the work date's, 0.
    """
    return _generated(configs, work_date, -F.col("retention"), F.col("pre_provisioned"))


def retained_partitions(configs: DataFrame, work_date: datetime.date | Column) -> DataFrame:
    """Those before the work date's."""
    return _generated(configs, work_date, -F.col("retention"), F.lit(-1))


def pre_provisioned_partitions(configs: DataFrame, work_date: datetime.date | Column) -> DataFrame:
    """Those after the work date's."""
    return _generated(configs, work_date, F.lit(1), F.col("pre_provisioned"))
