"""Difference between the partitions that are expected and those that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("ok", "missing", "unexpected", "incorrect_bounds")


def diff(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """(set_name, name, status, expected_lo, expected_hi, found_lo, found_hi), matched by set and name."""
    e = expected.select("set_name", "name", F.col("lo").alias("expected_lo"), F.col("hi").alias("expected_hi"))
    f = existing.select("set_name", "name", F.col("lo").alias("found_lo"), F.col("hi").alias("found_hi"))
    same = (F.col("expected_lo") == F.col("found_lo")) & (F.col("expected_hi") == F.col("found_hi"))
    status = (
        F.when(F.col("found_lo").isNull(), "missing")
        .when(F.col("expected_lo").isNull(), "unexpected")
        .when(same, "ok")
        .otherwise("incorrect_bounds")
    )
    return e.join(f, ["set_name", "name"], "full_outer").select(
        "set_name", "name", status.alias("status"), "expected_lo", "expected_hi", "found_lo", "found_hi"
    )


def missing(expected: DataFrame, existing: DataFrame) -> DataFrame:
    return expected.join(existing, ["set_name", "name"], "left_anti")


def unexpected(expected: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.join(expected, ["set_name", "name"], "left_anti")


def incorrect_bounds(expected: DataFrame, existing: DataFrame) -> DataFrame:
    return diff(expected, existing).where("status = 'incorrect_bounds'")


def counts(differences: DataFrame) -> DataFrame:
    """A row a set: n_ok, n_missing, n_unexpected, n_incorrect_bounds."""
    return differences.groupBy("set_name").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES))
