"""Check: does what exists equal what is configured?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeparts import errors
from rangeparts.operators import diff, ranges


def layout_check(configs: DataFrame, expected: DataFrame, existing: DataFrame) -> DataFrame:
    """(set_name, error, n_ok, n_missing, n_unexpected, n_incorrect_bounds) of every set; no error means that all is well.

    A set whose partitions are not contiguous has that error, and its differences are counted all the same.
    """
    found = ranges.global_range(existing).select("set_name", F.col("error").alias("range_error"))
    counted = diff.counts(diff.diff(expected, existing))
    wrong = F.col("n_missing") + F.col("n_unexpected") + F.col("n_incorrect_bounds") > 0
    rows = configs.select("set_name").join(counted, "set_name", "left").join(found, "set_name", "left")
    return rows.select(
        "set_name", F.coalesce("range_error", F.when(wrong, errors.LAYOUT_MISMATCH)).alias("error"),
        *(F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in diff.STATUSES),
    )


def check(configs: DataFrame, expected: DataFrame, existing: DataFrame, key_errors: DataFrame) -> DataFrame:
    """``layout_check``, where an error of the key comes first."""
    keyed = key_errors.select("set_name", F.col("error").alias("key_error"))
    rows = layout_check(configs, expected, existing).join(keyed, "set_name", "left")
    return rows.withColumn("error", F.coalesce("key_error", "error")).drop("key_error")
