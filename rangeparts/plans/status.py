"""Status of a run from what its sets report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failed(results: DataFrame) -> DataFrame:
    """One row (failed, n_failed): whether any set has an error."""
    bad = F.col("error").isNotNull()
    return results.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"), F.count_if(bad).alias("n_failed"))
