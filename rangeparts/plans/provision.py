"""Provisioning: what of the expected partitions lies outside of what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeparts.functions import names
from rangeparts.operators import ranges


def segments(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """(set_name, parent_table, schema, name, lo, hi, segment) of the ranges to create.

    An expected partition that has nothing of the set's existing range is created whole ("full"). One
    that sticks out of it is created from where it begins to where that begins ("left"), or from where
    that ends ("right"), or both. Nothing is ever created inside the existing range, and nothing at
    all for a set whose expected and existing ranges are equal. A set without partitions gets all.
    """
    now = ranges.global_range(existing).select("set_name", F.col("lo").alias("now_lo"), F.col("hi").alias("now_hi"))
    goal = ranges.global_range(expected).select("set_name", F.col("lo").alias("goal_lo"), F.col("hi").alias("goal_hi"))
    lo, hi, now_lo, now_hi = (F.col(c) for c in ("lo", "hi", "now_lo", "now_hi"))
    columns = [c for c in ("set_name", "parent_table", "schema", "name", "lo", "hi")]
    rows = expected.select(*columns).join(goal, "set_name").join(now, "set_name", "left")
    rows = rows.where(now_lo.isNull() | ~ranges.equal(F.col("goal_lo"), F.col("goal_hi"), now_lo, now_hi))
    left = F.struct(names.segment_name("parent_table", lo, now_lo).alias("name"), lo.alias("lo"), now_lo.alias("hi"), F.lit("left").alias("segment"))
    right = F.struct(names.segment_name("parent_table", now_hi, hi).alias("name"), now_hi.alias("lo"), hi.alias("hi"), F.lit("right").alias("segment"))
    full = F.struct(F.col("name"), lo.alias("lo"), hi.alias("hi"), F.lit("full").alias("segment"))
    parts = F.array_compact(
        F.array(
            F.when(now_lo.isNull() | ranges.disjoint(lo, hi, now_lo, now_hi), full),
            F.when(ranges.sticks_out_left(lo, hi, now_lo), left),
            F.when(ranges.sticks_out_right(lo, hi, now_hi), right),
        )
    )
    return rows.select("set_name", "parent_table", "schema", F.explode(parts).alias("s")).select("set_name", "parent_table", "schema", "s.*")


def provisioning_plan(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Actions "create" in the order of their bounds within each set."""
    order = Window.partitionBy("set_name").orderBy("lo", "hi")
    return segments(expected, existing).select(
        "set_name", F.row_number().over(order).alias("seq"), F.lit("create").alias("action"), "parent_table", "schema", "name", "lo", "hi", "segment"
    )
