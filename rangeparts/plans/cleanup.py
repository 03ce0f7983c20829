"""Cleanup: partitions that lie wholly outside of the expected range, before it or after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeparts.operators import ranges


def outdated(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """The existing partitions to remove; those that reach into the expected range stay, as do all if both ranges are equal."""
    goal = ranges.global_range(expected).select("set_name", F.col("lo").alias("goal_lo"), F.col("hi").alias("goal_hi"))
    now = ranges.global_range(existing).select("set_name", F.col("lo").alias("now_lo"), F.col("hi").alias("now_hi"))
    lo, hi, goal_lo, goal_hi = (F.col(c) for c in ("lo", "hi", "goal_lo", "goal_hi"))
    rows = existing.join(goal, "set_name").join(now, "set_name")
    rows = rows.where(~ranges.equal(goal_lo, goal_hi, F.col("now_lo"), F.col("now_hi")) & ranges.disjoint(lo, hi, goal_lo, goal_hi))
    return rows.select(*existing.columns)


def cleanup_plan(configs: DataFrame, expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Actions of each set: "detach", then "drop" where the policy says so, in the order of bounds."""
    policies = configs.select("set_name", "cleanup_policy")
    rows = outdated(expected, existing).join(policies, "set_name")
    actions = F.when(F.col("cleanup_policy") == "drop", F.array(F.lit("detach"), F.lit("drop"))).otherwise(F.array(F.lit("detach")))
    order = Window.partitionBy("set_name").orderBy("lo", "hi", "name", "place")
    return rows.select("*", F.posexplode(actions).alias("place", "action")).select(
        "set_name", F.row_number().over(order).alias("seq"), "action", "parent_table", "schema", "name", "lo", "hi"
    )


def blocked(existing: DataFrame) -> DataFrame:
    """(set_name, error) of the sets whose partitions are not contiguous; any such row stops the cleanup of all sets."""
    return ranges.global_range(existing).where("error is not null").select("set_name", "error")
